"""Fixed values of the matching rules: word lists, patterns and thresholds, stated as they must be."""

from __future__ import annotations

from dataclasses import dataclass

#: Canonical word and its variants.
SYNONYMS = {
    "V": ["VOLT", "VOLTS", "VOLTAGE"],
    "EXT": ["EXTENSION", "EXTENDED"],
    "CBL": ["CABLE", "CABLES"],
    "ASSY": ["ASSEMBLY"],
    "CONN": ["CONNECTOR", "CONNECTORS"],
    "MOD": ["MODULE", "MODULES"],
    "SW": ["SWITCH", "SWITCHES"],
    "TERM": ["TERMINAL"],
    "DEG": ["DEGREE", "DEGREES"],
    "EA": ["EACH", "PIECE", "PIECES", "PCS"],
    "W": ["WIRE"],
    "LIGHTING": ["LTG", "LTGS"],
    "WHIP": ["WHIPS"],
    "STRUT": ["UNISTRUT"],
    "TRAY": ["TROF", "TROUGH"],
    "PVC": ["PLASTIC"],
    "FITTING": ["FITTINGS", "JOINER", "JOINERS"],
    "FLEX": ["FLEXIBLE", "FMC"],
    "GALV": ["GALVANIZED", "GALVANISED"],
    "COUPLING": ["COUPLINGS", "CPLG"],
    "GRAY": ["GREY"],
    "EG": ["ELECTROGALVANIZED"],
    "LT": ["LIQUIDTIGHT"],
    "SEPARATOR": ["DIVIDER", "BARRIER"],
}
CANONICAL = {v: k for k, group in SYNONYMS.items() for v in [k, *group]}

#: Words without meaning in a request.
NOISE = [
    "PLEASE", "QUOTE", "QUOTATION", "PRICING", "PRICE", "PRICES", "PROVIDE", "NEEDED", "NEED", "WANT",
    "WANTED", "REQUIRE", "REQUIRED", "REQUIREMENT", "QTY", "QUANTITY", "PIECE", "PIECES", "PCS", "EACH",
    "EA", "UNITS", "UNIT", "OF", "FOR", "THE", "A", "AN", "TO", "FROM", "AND",
]
STOPWORDS = ["WITH", "AND", "THE", "A", "AN", "OF", "FOR", "TO", "X"]

#: What a bare category word stands for.
CATEGORY_DEFAULTS = {
    "PVC": "SCH40 BE CONDUIT GRAY RIGID",
    "EMT": "CONDUIT 10 FT",
    "GRC": "GALVANIZED RIGID CONDUIT 10 FT",
    "LT": "LIQUID TIGHT",
    "STRUT": "10 FT PG",
    "CHANNEL": "10 FT PG",
    "FLEX": "CONDUIT",
    "WHIP": "METALLIC",
}
COMPATIBLE = ["STEEL", "FIXTURE"]
UNIT_WORDS = ["IN", "FT", "V", "AMP"]
REQUIRED_WORDS = {"PVC": "SCH40"}

#: Colours, and that of a category whose request names none.
COLORS = ["GRAY", "GREY", "ORANGE", "WHITE", "BUFF", "BROWN", "GREEN", "BLACK", "RED", "BLUE", "YELLOW", "PURPLE"]
DEFAULT_COLORS = {"PVC": "GRAY"}

#: Words of prose, never part of a code.
PROSE = ["LIGHTING", "WHIP", "CABLE", "SWITCH", "MODULE", "CONDUIT", "HEAD", "EXT", "END", "DOUBLE", "VOLTAGE", "PVC", "EMT", "GRC", "LT", "STRUT", "CHANNEL", "FLEX"]

#: Words that call for further words, each set tested against the request as given.
PHRASES = [
    (["STL", "SS"], "STEEL SET SCREW"),
    (["CONDUIT", "CLAMP"], "HANGER CLAMP"),
    (["HANGER", "CLAMP"], "CONDUIT CLAMP"),
    (["SPRING", "NUT"], "CHANNEL NUT WITH SPRING"),
    (["GRC", "HUB"], "CONDUIT HUB"),
    (["FLEX", "CONN"], "SQUEEZE CONNECTOR"),
]
INTERCHANGEABLE = [("CLAMP", ["CONDUIT", "HANGER"]), ("CONN", ["FLEX", "SQUEEZE"]), ("HUB", ["GRC", "CONDUIT"])]
ACRONYMS = [
    (r"\bELECTRICAL\s+METALLIC\s+TUBING\b", "EMT"),
    (r"\bSS\s+CONN\b", "SET SCREW CONNECTOR"),
    (r"\bCOMP\s+CONN\b", "COMPRESSION CONNECTOR"),
    (r"\bCOMP\s+CPLG\b", "COMPRESSION COUPLING"),
    (r"\bWATERFALL\b", "DROP OUT"),
]
FINISHES = ["EG", "HG", "PL", "PG", "DF", "GR", "SS", "ST", "AL", "ZD", "EA", "EV"]
MARKERS = ["ELBOW", "SUPER FITTING", "RIGID", "THREADED", "IMC", "GRC", "NIPPLE", "COUPLING", "STRAP", "CONN"]
KNOWN_PHRASES = ["SWITCH MODULE", "LIGHTING WHIP", "LIGHTING CABLE", "EXT CABLE", "EXT WHIP", "DBL HEAD", "DBL END", "WHIP END", "ISO GROUND"]

#: Quantity phrases in order.
QUANTITIES = [
    r"\bneed\s+(\d+)\s*-",
    r"\bneed\s+(\d+)\b",
    r"\bplease\s+provide\s+(\d+)\b",
    r"\bprovide\s+(\d+)\b",
    r"\bquote\s+(\d+)\b",
    r"\b(?:qty|quantity)\s*[:=]?\s*(\d+)\b",
    r"\b(\d+)\s+(?:pcs|pieces|ea|each|units|unit)\b",
    r"\b(\d+)\s+of\b",
]
TOTAL_ROW = r"(?i)\b(sub[- ]?total|grand\s+total|totals?)\b"


@dataclass(frozen=True)
class MatchingConfig:
    """Thresholds and weights of scoring and decisions."""

    weight_exact: float = 0.40
    weight_token: float = 0.25
    weight_fuzzy: float = 0.20
    weight_attribute: float = 0.15
    min_match: float = 5.0
    candidate_floor: float = 5.0
    min_gap: float = 5.0
    tie: float = 0.5
    high: float = 90.0
    ambiguous_cap: float = 86.0
    conflict_cap: float = 40.0
    partial_cap: float = 78.0
    compatible_min: float = 50.0
    dimension_floor: float = 92.0
    preferred_bonus: float = 5.0
    purchase_bonus: float = 5.0
    retrieval_limit: int = 100
    pool_limit: int = 150
    text_limit: int = 30
    max_candidates: int = 10
    published: int = 6
    partial_share: float = 0.6
    max_positions: int = 8

    def __post_init__(self) -> None:
        total = self.weight_exact + self.weight_token + self.weight_fuzzy + self.weight_attribute
        if abs(total - 1) > 1e-9:
            raise ValueError(f"score weights sum to {total}, not 1")
