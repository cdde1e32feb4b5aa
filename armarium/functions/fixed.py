"""Names, titles, patterns and factors that results depend on."""

from __future__ import annotations

# Authors by era, in order of precedence.
AUTHORS_BY_ERA = {
    "classical": (
        "marcus tullius cicero", "cicero", "gaius iulius caesar", "caesar", "publius vergilius maro", "vergilius", "virgilius",
        "quintus horatius flaccus", "horatius", "publius ovidius naso", "ovidius", "titus livius", "livius", "cornelius tacitus", "tacitus",
        "gaius valerius catullus", "catullus", "plinius", "plinius maior", "plinius minor", "titus maccius plautus", "plautus",
        "publius terentius afer", "terentius", "quintilianus", "seneca", "lucretius", "sallustius", "iuvenalis", "martialis", "propertius",
        "tibullus", "persius", "lucanus", "statius", "suetonius", "apuleius", "aulus gellius", "varro", "columella", "vitruvius", "celsus",
        "phaedrus", "curtius rufus", "valerius maximus", "firmicus maternus",
    ),
    "late_antique": (
        "hieronymus", "augustinus", "ambrosius", "ambrosiaster", "tertullianus", "cyprianus", "lactantius", "rufinus", "leo i", "leo magnus",
        "petrus chrysologus", "maximus", "eusebius vercellensis", "hilarius", "prudentius", "boethius", "cassiodorus", "sidonius apollinaris",
        "ennodius", "orosius", "sulpicius severus", "ulfilas", "vincentius lerinensis", "iohannes cassianus", "salvianus", "arnobius",
        "venantius fortunatus", "gregorius magnus", "isidorus", "isidorus hispalensis",
    ),
    "early_medieval": (
        "rabanus maurus", "hrabanus maurus", "beda", "beda venerabilis", "alcuinus", "hincmarus rhemensis", "haymo halberstatensis",
        "paschasius radbertus", "remigius antissiodorensis", "atto vercellensis", "joannes scotus erigena", "iohannes scotus erigena",
        "odo cluniacensis", "flodoardus remensis", "angelomus luxovensis", "ado viennensis", "ratherius veronensis", "freculphus lexovensis",
        "nicolaus i", "walahfrid strabo", "einhardus", "paulus diaconus", "smaragdus", "florus lugdunensis", "agobardus",
        "hrothsuita gandersheimensis", "gregorius turonensis", "aldhelmus", "theodulfus", "amalarius", "sedulius scottus", "lupus servatus",
        "ionas aurelianensis", "prudentius trecensis",
    ),
    "high_medieval": (
        "anselmus laudunensis", "anselmus cantuariensis", "urbanus ii", "paschalis ii", "innocentius ii", "eugenius iii",
        "bernardus claraevallensis", "petrus abaelardus", "petrus lombardus", "hugo de sancto victore", "thomas aquinas", "bonaventura",
        "albertus magnus", "ivo carnotensis", "petrus damiani", "rupertus tuitiensis", "honorius augustodunensis", "gratianus", "petrus comestor",
        "guillelmus durandus", "iohannes saresberiensis",
    ),
    "late_medieval": (
        "guillelmus de ockham", "iohannes buridanus", "duns scotus", "boccaccio", "petrarca", "franciscus petrarcha", "thomas a kempis",
        "iohannes gerson",
    ),
    "neo_latin": (
        "erasmus", "desiderius erasmus", "pius ii", "aeneas silvius piccolomini", "thomas morus", "nicolaus copernicus", "galileo galilei",
        "isaac newtonus", "franciscus baconus", "spinoza", "leonhardus euler", "carolus linnaeus", "iohannes kepler", "rene descartes",
        "melanchthon", "lutherus", "calvinus", "sebastianus castellio", "ioannes ludovicus vives",
    ),
}

# Titles by era; of equal lengths the earlier one counts.
TITLES_BY_ERA = (
    ("late_antique", (
        "de civitate dei", "enarrationes in psalmos", "in evangelium ioannis tractatus", "in ioannis evangelium tractatus", "contra iulianum",
        "opus imperfectum contra", "confessiones", "de doctrina christiana", "de trinitate", "retractationes",
    )),
    ("neo_latin", (
        "dissertationes de historia pelagiana",
    )),
    ("late_antique", (
        "moralia", "in vergilii aeneidem commentarii", "etymologiarum libri", "institutiones divinarum", "de consolatione philosophiae",
        "historia ecclesiastica", "vulgata", "biblia sacra", "codex amiatinus",
    )),
    ("classical", (
        "ab urbe condita", "naturalis historia", "de institutione oratoria", "de bello gallico", "de bello civili", "de re coquinaria",
        "de lingua latina", "de architectura", "strategemata", "mathesis", "metamorphoses", "de rerum natura", "de viris illustribus urbis romae",
    )),
    ("high_medieval", (
        "summa theologiae", "summa contra gentiles", "historia scholastica", "logica ingredientibus", "historia regum britanniae",
        "libri v decretalium", "collectio decretalium",
    )),
    ("early_medieval", (
        "de divisione naturae",
    )),
    ("high_medieval", (
        "sermones in canticum canticorum",
    )),
    ("late_medieval", (
        "summa logicae", "summulae de dialectica", "quaestiones subtilissimae in metaphysicen", "de genealogiis deorum gentilium",
        "malleus maleficarum", "de imitatione christi",
    )),
    ("neo_latin", (
        "erasmi colloquia", "de revolutionibus orbium", "discorsi e dimostrazioni", "le opere di galileo", "ad exercitia linguae latinae dialogi",
        "de interpretatione recta",
    )),
    ("compilation", (
        "gallia christiana", "patrologia latina", "enchiridion symbolorum", "regesta sive epistolae", "acta sanctorum", "monumenta germaniae",
        "concilium", "missale mixtum", "liber sacramentorum", "hymni ecclesiae", "eclogae latinae",
    )),
)

# Works of the canon, found anywhere in a work's name.
CANON = (
    "de bello gallico", "de bello civili", "ab urbe condita", "naturalis historia", "de officiis", "de oratore", "de finibus", "de natura deorum",
    "tusculanae", "epistulae", "de re publica", "de legibus", "de amicitia", "de senectute", "in catilinam", "pro milone", "philippicae", "brutus",
    "orator", "annales", "historiae", "germania", "agricola", "de institutione oratoria", "bellum catilinae", "bellum iugurthinum",
    "de architectura", "de lingua latina", "de re rustica", "strategemata", "factorum ac dictorum", "aeneis", "aeneid", "georgica", "bucolica",
    "eclogae", "metamorphoses", "ars amatoria", "fasti", "tristia", "heroides", "carmina", "odae", "epodi", "satirae", "saturae",
    "epistulae ex ponto", "de rerum natura", "pharsalia", "thebais", "silvae", "epigrammata", "elegiae", "punica", "argonautica", "amphitruo",
    "aulularia", "menaechmi", "miles gloriosus", "captivi", "mostellaria", "rudens", "pseudolus", "andria", "eunuchus", "adelphoe", "phormio",
    "hecyra", "heautontimorumenos", "medea", "phaedra", "thyestes", "oedipus", "confessiones", "de civitate dei", "de trinitate",
    "de doctrina christiana", "vulgata", "biblia sacra", "de consolatione philosophiae", "etymologiarum", "regula", "moralia",
    "historia ecclesiastica", "adversus haereses", "divinae institutiones", "apologeticum", "summa theologiae", "summa contra gentiles",
    "sic et non", "historia calamitatum", "cur deus homo", "proslogion", "monologion", "de divisione naturae", "historia regum britanniae",
    "gesta francorum", "chronica majora", "sententiae", "didascalicon", "policraticus", "summa logicae", "carmina burana", "dies irae",
    "stabat mater", "encomium moriae", "colloquia familiaria", "adagia", "utopia", "de revolutionibus orbium", "sidereus nuncius", "principia",
    "novum organum", "ethica", "meditationes de prima philosophia", "systema naturae",
)

# Beginnings of title words by genre, the first genre that fits counts.
GENRES = (
    ("exegesis", "commentari|expositio|enarratio|glossa|catena|quaestiones? in|tractatus super|breviarium in"),
    ("letters", "epistol|epistul|litterae|regesta"),
    ("sermons", "sermo|homili|conciones"),
    ("history_hagiography", "historia|chronic|annales|gesta|res gestae|de bello|vita|vitae|passio|acta|martyr|legenda"),
    ("philosophy_scholastic", "summa|logic|dialectic|metaphysic|quaestiones|sententiae|de anima|physic|ethic|topica|analytic"),
    ("poetry", "carmen|carmina|hymn|poema|eclog|elegi|versus|aeneid|metamorph|satur"),
    ("law_canon", "decret|canon|concili|constitutio|privilegi|lex|leges|institutiones|digest|bulla"),
    ("liturgy", "missal|sacramentari|breviari|liturg|officium|ordo romanus|antiphon|benedictio|oratio"),
    ("scripture", "biblia|vulgata|evangeli|genesis|exodus|psalm|apocalyps|testamentum|pentateuch"),
    ("science_technical", "de re coquinaria|naturalis historia|de architectura|mathesis|astronom|medicin|herbari|de universo|etymolog|computo|revolutionibus|de lingua"),
    ("rhetoric_dialogue", "colloqui|dialogi|de institutione oratoria|rhetoric|declamatio|orationes"),
    ("monastic_devotional", "regula|de moribus|confessio|meditatio|speculum|de imitatione"),
)

# Words that show a text isn't Latin, signs that are plausible in Latin print, and bracketed words that are no authors.
NON_LATIN = "the|and|of|that|with|from|this|which|there|would|about|und|der|die|das|nicht|eine|auch|aber|sich|dieser|les|des|une|dans|pour|avec|cette|nous|vous|della|degli|questo|essere"
PLAUSIBLE = r"a-zA-ZāēīōūăĕĭŏŭæœÆŒ\s\.,;:!?'\"()\[\]\-–—0-9/*&%†‡§"
NO_AUTHOR = r"^(ed\.?\s*migne|migne|pl\s*\d+|patrologia.*|\d{3,4}|[ivxlcdm]+|kauer-lindsay.*|ed\..*|.*\bed\b\.?|vol\.?\s*\d+|t\.?\s*\d+)$"
# Series whose volumes are one work.
SERIES = ("patrologia latina", "gallia christiana", "acta sanctorum", "monumenta germaniae historica")
# Marked vowels and the plain ones.
MARKED, PLAIN = "āēīōūȳăĕĭŏŭўÁÉÍÓÚáéíóú", "aeiouyaeiouyAEIOUaeiou"

# Factors of the mixture profiles.
PROFILES = {
    "uniform": {"use_tier": False, "era": {}, "genre": {}, "canon": 1.0, "quality": False},
    "manifest": {"use_tier": True, "era": {}, "genre": {}, "canon": 1.0, "quality": False},
    "canonical": {
        "use_tier": False,
        "era": {"classical": 6.0, "late_antique": 2.0, "early_medieval": 1.0, "high_medieval": 1.5, "late_medieval": 1.5, "neo_latin": 2.0, "compilation": 0.4, "unknown": 0.6},
        "genre": {
            "poetry": 3.0, "rhetoric_dialogue": 2.5, "history_hagiography": 1.5, "philosophy_scholastic": 1.5, "science_technical": 1.2, "scripture": 1.0,
            "exegesis": 0.5, "sermons": 0.6, "letters": 0.8, "law_canon": 0.5, "liturgy": 0.4, "monastic_devotional": 0.8, "unknown": 0.8,
        },
        "canon": 5.0, "quality": True, "max_weight": 10.0,
    },
    "balanced": {
        "use_tier": False,
        "era": {"classical": 8.0, "late_antique": 2.0, "early_medieval": 0.7, "high_medieval": 2.0, "late_medieval": 4.0, "neo_latin": 5.0, "compilation": 0.5, "unknown": 1.0},
        "genre": {"exegesis": 0.5, "letters": 0.7, "liturgy": 0.5, "law_canon": 0.6},
        "canon": 1.5, "quality": True, "max_weight": 25.0,
    },
}


def author_era() -> list[tuple[str, str]]:
    return [(a, era) for era, authors in AUTHORS_BY_ERA.items() for a in authors]


def title_era() -> list[tuple[str, str]]:
    """Longest titles first."""
    return sorted(((t, era) for era, titles in TITLES_BY_ERA for t in titles), key=lambda x: -len(x[0]))
