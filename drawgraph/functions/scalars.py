"""Column functions on tags, references, sizes, files and boxes. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Valve type codes and instrument type codes of the tag grammar; a code in both is a valve.
VALVE_CODES = (
    "ESDV", "EZV", "SDV", "BDV", "PSV", "PRV", "TCV", "LCV", "FCV", "PCV", "MOV", "XV", "BFV", "GLV", "NRV", "CSE", "HV", "BV", "GV",
    "PV", "FV", "LV", "TV",
)
INSTRUMENT_CODES = (
    "PAHH", "PALL", "PAH", "PAL", "PDT", "PDI", "PIC", "PIT", "PZT", "PT", "PI", "PS",
    "TAHH", "TALL", "TAH", "TAL", "TIC", "TIT", "TT", "TI", "TS", "TE", "TW",
    "FAHH", "FALL", "FAH", "FAL", "FIC", "FIT", "FT", "FI", "FQ", "FE", "FS",
    "LAHH", "LALL", "LAH", "LAL", "LIC", "LIT", "LT", "LI", "LG", "LS", "LE",
    "AIC", "AT", "AI", "AS", "ZIC", "ZT", "ZI", "ZS", "SSHH", "SSH", "ST", "SI", "SE", "SS",
    "VT", "VI", "VS", "DT", "DI", "WT", "WI", "EIT", "JT", "UT", "UI", "YIC",
)
#: Abbreviated subtypes of compact extractions.
SUBTYPE_CODES = {
    "VG": "valve.gate", "VB": "valve.ball", "VBU": "valve.butterfly", "VCK": "valve.check", "VCT": "valve.control",
    "VS": "valve.spectacle", "EQ": "equipment", "IP": "instrument.pressure", "IT": "instrument.temperature", "IF": "instrument.flow",
    "IL": "instrument.level", "IC": "instrument.controller", "IAN": "instrument.analyzer", "J": "junction", "T": "terminator",
    "A": "annotation",
}
#: Enumerations of the graph schema.
NODE_TYPES = ("equipment", "valve", "instrument", "junction", "terminator", "nozzle", "annotation")
EDGE_KINDS = ("process", "signal", "impulse", "association", "containment")
LAYERS = ("process", "instrument", "electrical", "mechanical", "utility", "annotation", "other")
STATUSES = ("existing", "new", "removed", "future", "temporary")
FLOW_DIRS = ("uni", "bi")


def norm_tag(tag: Column, drop: str = r"\s\-") -> Column:
    """Upper case without blanks and hyphens; null gives ''."""
    return F.coalesce(F.regexp_replace(F.upper(tag), f"(?U)[{drop}]", ""), F.lit(""))


def norm_tag_strict(tag: Column) -> Column:
    return norm_tag(tag, r"\s\-_")


def norm_ref(ref: Column) -> Column:
    return norm_tag(ref, r"\s\-_./")


def tag_suffix_match(a: Column, b: Column) -> Column:
    """Whether the strict forms are equal or one ends with the other; never with an empty one."""
    x, y = norm_tag_strict(a), norm_tag_strict(b)
    return (x != "") & (y != "") & (x.endswith(y) | y.endswith(x))


def canonical_tag(tag: Column) -> Column:
    """Tags that differ by leading zeros or the separator become equal."""
    return F.regexp_replace(F.upper(tag), r"([A-Z]+)[- ]?0*(\d+)", "$1-$2")


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"[\d.]+", 0).try_cast("double")


def norm_size(text: Column) -> Column:
    """Lower case without blanks, quotes and the characters i and n."""
    return F.regexp_replace(F.lower(text), r"""(?U)[\s"'in]""", "")


def split_compound(tag: Column) -> Column:
    """Candidates of a compound tag: its first part, then each later part after the base stem, and alone.

    The base stem is the first part less one last letter.
    """
    parts = F.transform(F.split(tag, "[/,]"), lambda p: F.trim(p))
    stem = F.regexp_replace(parts[0], "[A-Za-z]$", "")
    later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    both = F.flatten(F.transform(later, lambda p: F.array(F.concat(stem, p), p)))
    return F.concat(F.array(parts[0]), both)


def px_to_pt(px: Column, dpi: float) -> Column:
    return F.round(px * F.lit(72.0) / F.lit(float(dpi)), 2)


def unrotate_box(left: Column, top: Column, width: Column, height: Column, rotation: Column, page_w: int, page_h: int) -> Column:
    """The box of a page that was turned 0, 90, 180 or 270 degrees counter-clockwise, on the page as it was."""

    def box(x: Column, y: Column, w: Column, h: Column) -> Column:
        zero = F.lit(0)
        return F.struct(F.greatest(zero, x).alias("x"), F.greatest(zero, y).alias("y"), w.alias("w"), h.alias("h"))

    return (
        F.when(rotation == 90, box(page_w - top - height, left, height, width))
        .when(rotation == 180, box(page_w - left - width, page_h - top - height, width, height))
        .when(rotation == 270, box(top, page_h - left - width, height, width))
        .otherwise(box(left, top, width, height))
    )


def tag_category(code: Column) -> Column:
    upper = F.upper(code)
    return F.when(upper.isin(*VALVE_CODES), "valve").when(upper.isin(*INSTRUMENT_CODES), "instrument").otherwise("unknown")


#: A tag is a code and a number of 3 to 6 digits, perhaps a second number and a letter; a line number is
#: size, PP number, system, fluid and specification.
TAG_PATTERN = (
    r"(?i)\b(" + "|".join(sorted({*VALVE_CODES, *INSTRUMENT_CODES}, key=lambda c: (-len(c), c))) + r")[- ]?(\d{3,6}(?:[/\\]\d{3,6})?[A-Z]?)\b"
)
LINE_PATTERN = r"""(?i)\b\d{1,3}"-?PP\d+-\d{3,4}-[A-Z]{2}\d{4}-[A-Z0-9]+\b"""


def match_tags(text: Column) -> Column:
    """``CODE-NUMBER`` of each tag in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(TAG_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(F.upper(t), r"^([A-Z]+)[- ]?(\d.*)$", "$1-$2"))


def line_numbers(text: Column) -> Column:
    """Distinct pipe-line numbers (size, PP number, system, fluid, specification), upper case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINE_PATTERN), F.lit(0)), lambda x: F.upper(x)))


def yolo_box(xmin: Column, ymin: Column, w: Column, h: Column, image_w: int, image_h: int) -> Column:
    """Centre and size as shares of the image, each in [0, 1]; null for a box without area."""
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(
        (w > 0) & (h > 0),
        F.struct(
            share((xmin + w / 2) / image_w).alias("cx"), share((ymin + h / 2) / image_h).alias("cy"),
            share(w / F.lit(image_w)).alias("bw"), share(h / F.lit(image_h)).alias("bh"),
        ),
    )


def lenient_json(text: Column) -> Column:
    """(json, parse_error): code fences, leading prose and trailing commas are taken away before giving up."""
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    from_brace = F.regexp_extract(bare, r"(?s)[\[{].*$", 0)
    fixed = F.regexp_replace(from_brace, r",(\s*[}\]])", "$1")
    parsed = F.coalesce(*(F.try_parse_json(c) for c in (bare, from_brace, fixed)))
    return F.struct(F.to_json(parsed).alias("json"), parsed.isNull().alias("parse_error"))


def pid_from_name(path: Column, known: dict[str, str] | None = None) -> Column:
    """Drawing id of a file: a known 30-character prefix, else PID-dddd, else the stem."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    number = F.regexp_extract(path, r"PID-(\d{4})", 1)
    rest = F.when(number != "", number).otherwise(stem)
    for prefix, pid in (known or {}).items():
        rest = F.when(F.left(stem, F.lit(30)) == prefix, pid).otherwise(rest)
    return rest


def tile_key(name: Column) -> Column:
    """(row, col) of 'r1c2', (0, 0) of other names."""
    get = lambda k: F.coalesce(F.regexp_extract(name, r"r(\d+)c(\d+)", k).try_cast("int"), F.lit(0))
    return F.struct(get(1).alias("row"), get(2).alias("col"))


def text_preview(text: Column, n: int = 500) -> Column:
    return F.regexp_replace(F.translate(F.substring(text, 1, n), "\n", " "), r"(?U)^\s+|\s+$", "")


def verdict_band(score: Column) -> Column:
    return F.when(score >= 80, "PASS").when(score >= 50, "PARTIAL").otherwise("FAIL")


def type_of_subtype(subtype: Column) -> Column:
    """Node type of an extracted subtype; abbreviated subtypes are written out first."""
    full = F.coalesce(F.create_map(*[x for k, v in SUBTYPE_CODES.items() for x in (F.lit(k), F.lit(v))])[F.upper(subtype)], subtype)
    head = F.split(full, r"\.")[0]
    return F.when(head.isin(*NODE_TYPES), head).otherwise("annotation")
