"""Column functions on labels, names, addresses and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Designators of legal form that end an organisation's name.
LEGAL_FORMS = [
    "llc", "llp", "lllp", "lp", "pllc", "pc", "pa", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd",
    "limited", "plc", "lc", "gmbh", "mbh", "ag", "kg", "kgaa", "ohg", "ug", "sa", "sas", "sarl", "sca",
    "spa", "srl", "snc", "nv", "bv", "cv", "ab", "as", "asa", "oy", "oyj", "pty", "pte", "bhd",
    "sdn", "sl", "slu", "aps", "doo", "ojsc", "oao", "zao", "ooo",
]
# Endings of several words.
LEGAL_PHRASES = ("and sons", "and son", "and co", "and company")
# Abbreviations of address words.
ADDRESS_WORDS = {
    "ave": "avenue", "av": "avenue", "st": "street", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "pl": "place", "sq": "square", "ter": "terrace", "terr": "terrace", "pkwy": "parkway", "pkway": "parkway",
    "hwy": "highway", "cir": "circle", "pt": "point", "plz": "plaza", "expy": "expressway",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "ste": "suite", "apt": "apartment", "fl": "floor", "rm": "room", "bldg": "building", "dept": "department",
}
# Ledger statuses.
STATUSES = ("VERIFIED", "CORROBORATED", "CAPTURED", "INFERRED", "REFUTED", "DRAFT-ONLY", "GAP", "UNSUPPORTED", "DOWNGRADED", "DISPUTED")
# Entity types that take a side, which never merge by likeness.
STANCE_TYPES = ("policy_position", "claim", "stance", "position")
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def norm(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def quoted(c: Column) -> Column:
    """A label as a literal pattern."""
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|])", r"\\$1")


def whole_word(label: Column, text: Column) -> Column:
    """Whether label stands in text with no word character on either side; labels under two characters don't."""
    return (F.length(label) >= 2) & F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)"), quoted(label), F.lit(r"(?!\w)")))


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTS, PLAIN)


def depunct(c: Column) -> Column:
    """Lower case without accents; & is a word, other marks are spaces; letters of any script stay."""
    s = F.regexp_replace(fold(c), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N} ]", " "), " +", " "))


def legal_pattern() -> str:
    """The shortest core before a run of legal forms, spaced-out abbreviations included."""
    spaced = [" ".join(f) for f in LEGAL_FORMS if len(f) > 1]
    return "^(.+?)(?: (?:" + "|".join([*LEGAL_PHRASES, *LEGAL_FORMS, *spaced]) + "))+$"


def norm_name(c: Column) -> Column:
    """Comparison key of a name: depunct without trailing legal forms, never emptied by that; null if blank."""
    return F.nullif(F.regexp_replace(depunct(c), legal_pattern(), "$1"), F.lit(""))


def strip_unicode(c: Column) -> Column:
    """Without separators and format characters, ordinary spaces included: for tests of emptiness."""
    return F.regexp_replace(c, r"[\p{Z}\p{Cf}]", "")


def norm_field(c: Column) -> Column:
    """Format characters out, separators to one space, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{Cf}", ""), r"[\p{Z}\s]+", " "))


def norm_reg(c: Column) -> Column:
    """A register number, null if nothing of it is a letter or digit."""
    return F.when(F.rlike(c, F.lit(r"[\p{L}\p{N}]")), norm_field(c))


def norm_address(c: Column) -> Column:
    """Address words in full: lower case, # in front and .,;:# behind dropped, abbreviations replaced."""
    words = F.create_map(*[F.lit(x) for kv in ADDRESS_WORDS.items() for x in kv])
    clean = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda t: F.regexp_replace(strip_unicode(t), r"^#+|[.,;:#]+$", ""))
    return F.array_join(F.transform(F.filter(clean, lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(words, t), t)), " ")


def entity_id(label: Column, kind: Column, url: Column) -> Column:
    """16 hex digits of SHA-256 over type, label and source."""
    return F.substring(F.sha2(F.concat_ws(":", kind, F.lower(F.trim(label)), url), 256), 1, 16)


def uuid5(name: Column, space: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """The name-based UUID (version 5); the space is that of DNS names."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of windows; a blank text has none, windows at the end stay though another covers them."""
    step = size - overlap
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substr(text, i + 1, F.lit(size)))
    return F.when(F.trim(text) != "", cut).otherwise(F.array().cast("array<string>"))


def cluster_key(kind: Column, label: Column) -> Column:
    """Type and comparison key of a name; null if the name is blank."""
    return F.concat(kind, F.lit("|"), norm_name(label))


def year(c: Column) -> Column:
    """The first number of four digits that stands alone, or ''."""
    return F.regexp_extract(c, r"\b(\d{4})\b", 1)


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule (pattern, name) whose pattern the text holds."""
    return F.coalesce(*[F.when(c.rlike(pattern), name) for pattern, name in rules], F.lit(default))


def all_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The names of all rules whose pattern the text holds, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(c.rlike(pattern), name) for pattern, name in rules])) if rules else F.array().cast("array<string>")


#: Characters kept of evidence, by who writes it.
EVIDENCE_CAP, LOADER_CAP = 500, 480


def capped(c: Column, most: int = EVIDENCE_CAP) -> Column:
    """Evidence, cut to the cap that graph rows have."""
    return F.substring(c, 1, most)


DATE = r"\d{4}-\d{2}-\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? \d{4}"
MONEY = r"\$[\d,]+(?:\.\d{2})?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def to_double(c: Column) -> Column:
    """'55', '55%', '50,000' as numbers, anything else null."""
    s = F.regexp_replace(F.trim(c), r"%+$|,", "")
    return F.when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), s.cast("double"))


def percent(c: Column) -> Column:
    """A fraction of 0 or more as a percentage with one decimal, rounded as C's printf does: by the double's exact value, ties to even."""
    v = c * 100
    part = v - F.floor(v)
    # Ten times the part, as a double and what that double lacks: both are exact.
    tenths = part * 8 + part * 2
    rest = part * 2 - (tenths - part * 8)
    half = tenths - F.floor(tenths) == 0.5
    near = F.when(half & (rest > 0), F.ceil(tenths)).when(half & (rest < 0), F.floor(tenths)).otherwise(F.rint(tenths).cast("long"))
    return F.concat((F.floor(v) + F.when(near == 10, 1).otherwise(0)).cast("string"), F.lit("."), F.pmod(near, F.lit(10)).cast("string"), F.lit("%"))


def share(c: Column) -> Column:
    """A percentage as a fraction; missing stays null."""
    return to_double(c.cast("string")) / 100


def iso_millis(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def snippet(c: Column, n: int = 200) -> Column:
    flat = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def row_text(**cells: Column) -> Column:
    """k=v of the cells that aren't blank."""
    parts = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in cells.items()]
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def status(c: Column) -> Column:
    """The closed-set status that a decorated cell starts with, or ''."""
    s = F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, r"\*", " "), r"(?s)[(—→].*$", "")))
    known = "|".join(sorted(STATUSES, key=lambda x: -len(x)))
    return F.regexp_extract(s, rf"^({known})(?:[\s,/]|$)", 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles, null if a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def stance_bearing(kind: Column, types: tuple[str, ...] = STANCE_TYPES) -> Column:
    return F.lower(F.trim(kind)).isin(*types)


def semantic_verdict(type_a: Column, type_b: Column, cos: Column, lower: float = 0.93, upper: float = 0.9985) -> Column:
    """exclude or review: stance types first, then scores too close to one, then the alias band."""
    return (
        F.when(stance_bearing(type_a) | stance_bearing(type_b), "exclude")
        .when(cos >= upper, "exclude")
        .when((cos >= lower) & (cos < upper), "review")
        .otherwise("exclude")
    )


def decide(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """(decision, reason) of a pair by register number, address, name and jurisdiction; blanks are null."""
    same_addr = F.coalesce(a["address"] == b["address"], F.lit(False))
    juris = F.coalesce(a["jurisdiction"] != b["jurisdiction"], F.lit(False))
    same_reg = F.coalesce(a["reg_id"] == b["reg_id"], F.lit(False))
    any_reg = a["reg_id"].isNotNull() | b["reg_id"].isNotNull()
    same_name = F.coalesce(a["name"] == b["name"], F.lit(False))
    decision = (
        F.when(a["type"] != b["type"], "apart")
        .when(same_reg & same_addr & ~juris, "merge")
        .when(same_reg, "review")
        .when(any_reg, "apart")
        .when(same_name & same_addr, "merge")
        .otherwise("apart")
    )
    missing = a["address"].isNull() | b["address"].isNull()
    reason = F.when(decision == "review", F.when(juris, "jurisdiction mismatch").when(missing, "address missing").otherwise("address mismatch"))
    return decision, reason
