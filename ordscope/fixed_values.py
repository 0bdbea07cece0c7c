"""Constants that results must agree on.

Everything in this module is a given (codes, names, price levels, templates,
colour anchors), not logic. Entries stand in their natural order.
"""

from __future__ import annotations

# Default ordinal scale, seed, interval level.
BINS: tuple[int, ...] = tuple(range(1, 12))
BASE_SEED = 20260514
N_REPLICATES = 1000
CI_LEVEL = 0.95
SECONDS_PER_DAY = 86_400

# Columns of a labelling sheet.
LABELLING_COLUMNS: tuple[str, ...] = (
    "image_id",
    "occupation",
    "language",
    "model",
    "country",
    "path",
    "label_a",
    "label_b",
    "adjudication",
    "notes",
)
SAMPLE_PER_GROUP = 12

# The study groups: name, Spanish noun, Portuguese noun, ISCO-08 minor
# and major code, status tier, prior centre on the scale.
GROUPS: tuple[tuple[str, str, str, str, str, str, float], ...] = (
    ("CEO", "director general", "diretor geral", "112", "1", "high", 2.5),
    ("doctor", "médico", "médico", "221", "2", "high", 3.0),
    ("software engineer", "ingeniero de software", "engenheiro de software", "251", "2", "high", 3.5),
    ("lawyer", "abogado", "advogado", "261", "2", "high", 3.0),
    ("university professor", "profesor universitario", "professor universitário", "231", "2", "high", 3.5),
    ("architect", "arquitecto", "arquiteto", "216", "2", "high", 3.5),
    ("accountant", "contador", "contador", "241", "2", "medium", 4.0),
    ("journalist", "periodista", "jornalista", "264", "2", "medium", 4.0),
    ("nurse", "enfermero", "enfermeiro", "222", "2", "medium", 5.0),
    ("police officer", "policía", "policial", "541", "5", "medium", 5.5),
    ("mechanic", "mecánico", "mecânico", "723", "7", "medium", 6.0),
    ("salesperson", "vendedor", "vendedor", "522", "5", "medium", 5.5),
    ("secretary", "secretario", "secretário", "412", "4", "medium", 4.5),
    ("cook", "cocinero", "cozinheiro", "512", "5", "medium", 5.5),
    ("hairdresser", "peluquero", "cabeleireiro", "514", "5", "medium", 5.0),
    ("driver", "conductor", "motorista", "832", "8", "medium", 6.0),
    ("security guard", "vigilante", "vigilante", "541", "5", "medium", 6.0),
    ("farmer", "agricultor", "agricultor", "611", "6", "low", 7.0),
    ("nanny", "niñero", "babá", "531", "5", "low", 6.5),
    ("construction worker", "obrero de construcción", "operário de construção", "931", "9", "low", 7.0),
    ("seamstress", "costurero", "costureiro", "753", "7", "low", 5.5),
    ("janitor", "conserje", "zelador", "911", "9", "low", 7.0),
    ("domestic worker", "empleado doméstico", "empregado doméstico", "911", "9", "low", 7.0),
    ("street vendor", "vendedor callejero", "vendedor ambulante", "952", "9", "low", 7.0),
    ("waste collector", "recolector", "coletor de lixo", "961", "9", "low", 7.5),
)
GROUP_NAMES: tuple[str, ...] = tuple(g[0] for g in GROUPS)

# National four-digit codes known so far (CO, MX, BR, PE).
NATIONAL_CODES: dict[str, tuple[str, str, str, str]] = {
    "CEO": ("1120", "111", "121", "1120"),
    "nurse": ("2221", "2421", "2235", "2221"),
    "domestic worker": ("9111", "9611", "5121", "9111"),
}

# Spread of the prior distribution.
PRIOR_SD = 1.7

# Monthly income priors per country and group, local currency.
PRIOR_INCOME: dict[str, dict[str, int]] = {
    "CO": {
        "CEO": 18_000_000,
        "doctor": 8_500_000,
        "software engineer": 7_500_000,
        "lawyer": 6_800_000,
        "university professor": 6_500_000,
        "architect": 6_000_000,
        "accountant": 4_200_000,
        "journalist": 3_500_000,
        "nurse": 3_200_000,
        "police officer": 2_500_000,
        "mechanic": 2_400_000,
        "salesperson": 2_000_000,
        "secretary": 2_300_000,
        "cook": 1_800_000,
        "hairdresser": 1_700_000,
        "driver": 2_200_000,
        "security guard": 1_700_000,
        "farmer": 1_400_000,
        "nanny": 1_200_000,
        "construction worker": 1_600_000,
        "seamstress": 1_300_000,
        "janitor": 1_400_000,
        "domestic worker": 950_000,
        "street vendor": 900_000,
        "waste collector": 1_100_000,
    },
    "MX": {
        "CEO": 250_000,
        "doctor": 90_000,
        "software engineer": 75_000,
        "lawyer": 70_000,
        "university professor": 65_000,
        "architect": 60_000,
        "accountant": 35_000,
        "journalist": 28_000,
        "nurse": 28_000,
        "police officer": 22_000,
        "mechanic": 18_000,
        "salesperson": 15_000,
        "secretary": 18_000,
        "cook": 12_000,
        "hairdresser": 12_000,
        "driver": 16_000,
        "security guard": 12_000,
        "farmer": 10_000,
        "nanny": 9_000,
        "construction worker": 13_000,
        "seamstress": 11_000,
        "janitor": 11_000,
        "domestic worker": 7_500,
        "street vendor": 7_000,
        "waste collector": 9_000,
    },
    "BR": {
        "CEO": 60_000,
        "doctor": 22_000,
        "software engineer": 18_000,
        "lawyer": 17_000,
        "university professor": 16_000,
        "architect": 14_000,
        "accountant": 8_500,
        "journalist": 7_500,
        "nurse": 6_500,
        "police officer": 5_500,
        "mechanic": 4_500,
        "salesperson": 4_000,
        "secretary": 4_500,
        "cook": 3_200,
        "hairdresser": 3_000,
        "driver": 4_500,
        "security guard": 3_200,
        "farmer": 2_400,
        "nanny": 2_200,
        "construction worker": 3_400,
        "seamstress": 2_800,
        "janitor": 2_800,
        "domestic worker": 1_700,
        "street vendor": 1_800,
        "waste collector": 2_500,
    },
    "PE": {
        "CEO": 35_000,
        "doctor": 12_000,
        "software engineer": 9_000,
        "lawyer": 8_500,
        "university professor": 8_000,
        "architect": 7_500,
        "accountant": 4_500,
        "journalist": 3_800,
        "nurse": 3_500,
        "police officer": 2_800,
        "mechanic": 2_500,
        "salesperson": 2_200,
        "secretary": 2_400,
        "cook": 1_800,
        "hairdresser": 1_700,
        "driver": 2_400,
        "security guard": 1_700,
        "farmer": 1_400,
        "nanny": 1_200,
        "construction worker": 1_900,
        "seamstress": 1_500,
        "janitor": 1_500,
        "domestic worker": 1_050,
        "street vendor": 1_000,
        "waste collector": 1_300,
    },
}

# Survey country codes, survey columns, level sets per tier,
# codes that mean "missing", file name prefixes per country.
SURVEY_COUNTRY_CODES: dict[str, int] = {"CO": 8, "MX": 1, "BR": 15, "PE": 11}
SURVEY_COLUMNS: dict[str, str] = {
    "country": "pais",
    "bin": "colorr",
    "level": "edre",
    "income": "q10inc",
    "category": "etid",
}
TIER_LEVELS: dict[str, tuple[int, ...]] = {
    "high": (5, 6),
    "medium": (3, 4),
    "low": (0, 1, 2),
}
LEVEL_RANGE = (0, 6)
INCOME_SENTINELS: tuple[int, ...] = (88, 98, 99, 888888, 999999, -1)
LOW_N = 30
SURVEY_FILE_PREFIX: dict[str, str] = {"CO": "COL", "MX": "MEX", "BR": "BRA", "PE": "PER"}

# Grid dimensions.
MAIN_LANGUAGES: tuple[str, ...] = ("en", "es-ES", "es-LatAm", "pt-BR")
INDIGENOUS_LANGUAGES: tuple[str, ...] = ("qu", "gn")
COUNTRIES: tuple[str, ...] = ("CO", "MX", "BR", "PE")
MULTI_COUNTRY = "MULTI"
LANGUAGE_COUNTRY: dict[str, str] = {"es-ES": "MX", "es-LatAm": "CO", "pt-BR": "BR"}
DEFAULT_COUNTRY = "CO"
MAIN_MODELS: tuple[str, ...] = (
    "pollinations/flux",
    "runwayml/stable-diffusion-v1-5",
    "stabilityai/stable-diffusion-xl-base-1.0",
    "stabilityai/stable-diffusion-3.5-medium",
)
EXTRA_MODELS: tuple[str, ...] = (
    "stabilityai/stable-diffusion-2-1",
    "playgroundai/playground-v2.5-1024px-aesthetic",
    "kandinsky-community/kandinsky-3",
    "BAAI/AltDiffusion-m18",
)
MAIN_REPLICATES = 30
MARKER_REPLICATES = 10
ROBUSTNESS_REPLICATES = 10
POC_GROUPS: tuple[str, ...] = ("CEO", "nurse", "domestic worker")
POC_REPLICATES = 10
MARKER_GROUPS: tuple[str, ...] = (
    "CEO",
    "doctor",
    "lawyer",
    "architect",
    "nurse",
    "construction worker",
    "domestic worker",
    "street vendor",
)
MARKERS: dict[str, str] = {
    "unmarked": "",
    "LatAm": "Colombian ",
    "US": "American ",
    "EU": "European ",
}
ROBUSTNESS_GROUPS: tuple[str, ...] = (
    "CEO",
    "doctor",
    "lawyer",
    "nurse",
    "police officer",
    "salesperson",
    "cook",
    "construction worker",
    "domestic worker",
    "street vendor",
)

# Seed multipliers (base, group, language, model) and the offset
# of each grid's seed range.
SEED_MULTIPLIERS: tuple[int, int, int, int] = (10_000_000, 100_000, 10_000, 1_000)
SEED_OFFSETS: dict[str, int] = {
    "main": 0,
    "h5": 5_000_000_000,
    "robustness": 10_000_000_000,
    "robustness_indigenous": 20_000_000_000,
}
PROVIDER_SEED_MODULUS = 2**32

# Runner per model.
BACKEND_DEFAULT = "local_diffusers"
BACKEND_BY_MODEL: dict[str, str] = {"pollinations/flux": "pollinations"}
RUNNER_DEFAULT = "manual"
RUNNER_BY_MODEL: dict[str, str] = {
    "pollinations/flux": "local",
    "runwayml/stable-diffusion-v1-5": "kaggle",
    "stabilityai/stable-diffusion-xl-base-1.0": "kaggle",
    "stabilityai/stable-diffusion-3.5-medium": "colab",
    "stabilityai/stable-diffusion-2-1": "kaggle",
    "playgroundai/playground-v2.5-1024px-aesthetic": "kaggle",
    "kandinsky-community/kandinsky-3": "kaggle",
    "BAAI/AltDiffusion-m18": "kaggle",
}

# Prompt templates, articles, vowel prefixes with a consonant sound.
PROMPT_TEMPLATES: dict[str, str] = {
    "en": "a photo of {article}{noun}",
    "es-ES": "una fotografía de {article} {noun}",
    "es-LatAm": "una foto de {article} {noun}",
    "pt-BR": "uma foto de {article} {noun}",
}
ARTICLES: dict[str, str] = {"es-ES": "un", "es-LatAm": "un", "pt-BR": "um"}
CONSONANT_SOUND_PREFIXES: tuple[str, ...] = ("eu", "uni", "use", "ute", "one")

# Documented nouns in the two exploratory languages.
INDIGENOUS_NOUNS: dict[str, dict[str, str]] = {
    "qu": {
        "CEO": "umalliq",
        "doctor": "hampi kamayuq",
        "lawyer": "rimapakuq",
        "police officer": "runa qhawaq",
        "cook": "wayk'uq",
        "construction worker": "wasi ruraq",
        "domestic worker": "Wasimanta llank’aq chayri wasi ruwanata ruwaq",
        "nurse": "hampiq mama, hampiq tayta",
        "salesperson": "qhatuq",
        "street vendor": "ñanniqpi ranqhaq",
    },
    "gn": {
        "construction worker": "oga apoha",
        "domestic worker": "tembiguai",
        "nurse": "hasyva rerekua",
        "street vendor": "makatero",
        "CEO": "sãmbyhyha",
        "doctor": "pohanohára",
        "lawyer": "moʼãhára",
        "police officer": "tahachi",
        "salesperson": "ñemuhára",
        "cook": "tembiʼuʼapoha",
    },
}

# Angle classes (lower edge inclusive, upper edge exclusive).
ANGLE_EDGES: tuple[float, ...] = (-90.0, -30.0, 10.0, 28.0, 41.0, 55.0, 90.0)
ANGLE_LABELS: tuple[str, ...] = ("dark", "brown", "tan", "intermediate", "light", "very_light")
ANGLE_LIGHT_END = 55.0
ANGLE_DARK_END = -50.0
ANGLE_LUMINANCE_RANGE = (20.0, 95.0)

# Ten colour anchors (r, g, b), tone 1 to 10.
COLOUR_ANCHORS: tuple[tuple[int, int, int], ...] = (
    (246, 237, 228),
    (243, 231, 219),
    (247, 234, 208),
    (234, 218, 186),
    (215, 189, 150),
    (160, 126, 86),
    (130, 92, 67),
    (96, 65, 52),
    (58, 49, 42),
    (41, 36, 32),
)
COLOUR_LUMINANCE_RANGE = (15.0, 97.0)
COLOUR_NEUTRAL_TONE = 5

# Palette codes of the eleven tones, darkest (11) to lightest (1).
PALETTE_DARK_TO_LIGHT: tuple[str, ...] = (
    "#373028",
    "#422811",
    "#513b2e",
    "#6f503c",
    "#81654f",
    "#9d7a54",
    "#bea07e",
    "#e5c8a6",
    "#e7c1b8",
    "#f3dad6",
    "#fbf2f3",
)

# Classifier columns added to metadata, with type and sentinel.
CLASSIFIER_COLUMNS: tuple[tuple[str, str, object], ...] = (
    ("has_face", "boolean", False),
    ("n_faces", "int", 0),
    ("ita_value", "double", None),
    ("ita_label", "string", "not_classified"),
    ("ita_bin", "int", None),
    ("mst_value", "int", None),
    ("mst_bin", "int", None),
    ("palette_bin", "int", None),
    ("consensus_bin", "int", None),
    ("n_classifiers", "int", 0),
    ("n_concordant", "int", 0),
    ("concordant_2of3", "boolean", False),
)
CLASSIFIER_FAILURE_LABELS: tuple[str, ...] = ("classification_error", "classify_error")
NO_DETECTION_LABEL = "no_face"

# Context labels and the three that form the summed outcome.
CONTEXT_LABELS: tuple[str, ...] = (
    "a rural scene",
    "an urban scene",
    "a modern office",
    "an artisan workshop",
    "a folkloric landscape",
    "a neutral background",
)
OUTCOME_LABELS: tuple[str, ...] = (
    "a rural scene",
    "a folkloric landscape",
    "an artisan workshop",
)

# Characters that may not occur in a path component.
UNSAFE_PATH_CHARACTERS = '<>:"/\\|?*'

# Thresholds of the request-log rubric.
RATE_LIMIT_HARD = 0.20
OTHER_ERROR_HARD = 0.20
SEQUENTIAL_OK_MIN = 0.5
PLATEAU_GAIN = 1.15
RATE_LIMIT_SOFT = 0.05

# Tolerance of sum checks, effect threshold, error rate.
SUM_TOLERANCE = 1e-3
DISTRIBUTION_TOLERANCE = 1.1e-5
SHIFT_TOLERANCE = 1e-12
MIN_EFFECT = -0.5
FALSE_DISCOVERY_RATE = 0.05
