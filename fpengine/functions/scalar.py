"""Scalar string / JSON / array functions (FN1-FN22) as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: vendor alias map applied after normalisation
VENDOR_ALIASES = {"electroind": "electroindustries"}

# FIXED VALUES: rule-based question tags and their keywords (substring match)
PROBLEM_KEYWORDS = {
    "DEVICE_TYPE": ["type", "kine", "category", "device type", "what device"],
    "DEVICE_MANUFACTURER": ["manufacturer", "vendor", "brand"],
    "DEVICE_MODEL": ["model", "version"],
    "SIMILAR_DEVICES": ["similar", "like", "same"],
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_vendor(x) -> Column:
    """FN1: lower, keep [a-z0-9]; empty or null -> 'unknown'."""
    v = F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit("unknown"))


def strip_vendor(x) -> Column:
    """Vendor part of FN2 (no 'unknown' default)."""
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def apply_aliases(x: Column, aliases: Mapping[str, str] = VENDOR_ALIASES) -> Column:
    out = x
    for k, v in aliases.items():
        out = F.when(out == k, F.lit(v)).otherwise(out)
    return out


def normalize_label(x) -> Column:
    """FN2: 'type-vendor' -> lower(type) + '-' + aliased normalised vendor; labels without
    '-' are only lower-cased."""
    lab = _c(x)
    has = F.instr(lab, "-") > 0
    dt = F.substring_index(lab, "-", 1)
    vendor = F.substring(lab, F.instr(lab, "-") + 1, F.length(lab))
    return F.when(has, F.concat(F.lower(dt), F.lit("-"), apply_aliases(strip_vendor(vendor)))).otherwise(F.lower(lab))


def label_match(a, b) -> Column:
    return normalize_label(a) == normalize_label(b)


def strip_ws(x) -> Column:
    """Python-style strip() of ASCII whitespace."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def comma_tokenizer(x) -> Column:
    """FN3: split on ',', strip, drop blanks."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x).cast("string"), F.lit("")), ","), strip_ws),
                    lambda t: t != "")


def token_set(cols: Sequence[str]) -> Column:
    """FN4: distinct lower-cased comma tokens of several columns, 'unknown' dropped."""
    parts = [F.transform(comma_tokenizer(c), lambda t: F.lower(t)) for c in cols]
    allt = F.flatten(F.array(*parts))
    return F.array_sort(F.array_distinct(F.filter(allt, lambda t: t != "unknown")))


def chunk_text(x, max_length: int = 500, overlap: int = 50) -> Column:
    """FN5: chunks of ``max_length`` starting every ``max_length - overlap`` characters;
    empty text -> no chunk."""
    step = max_length - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than max_length")
    t = _c(x)
    n = F.length(t)
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(t, i + 1, max_length))) \
        .otherwise(F.array().cast(T.ArrayType(T.StringType())))


def parse_banner_hex(x) -> Column:
    """FN6: strip, drop spaces/newlines, hex -> bytes -> utf-8 ignoring bad bytes; null on bad hex."""
    h = F.translate(strip_ws(x), " \n", "")
    raw = F.unhex(h)
    text = F.make_valid_utf8(raw.cast("string"))
    return F.when(raw.isNotNull(), F.replace(text, F.lit("�"), F.lit("")))


def bits16(x) -> Column:
    """FN7: integer -> 16 binary digits (as text and as array<int>)."""
    return F.lpad(F.bin(_c(x).cast("long")), 16, "0")


def bit_list(x) -> Column:
    return F.transform(F.split(bits16(x), ""), lambda b: b.cast("int"))


def wrap_label(x, width: int = 30) -> Column:
    """FN8: drop trailing CR/LF; longer than ``width`` -> newline every ``width`` chars."""
    t = F.regexp_replace(_c(x), "[\r\n]+$", "")
    return F.when(F.length(t) > width, F.regexp_replace(t, f"(.{{{width}}})(?=.)", "$1\n")).otherwise(t)


def json_from_fenced(x) -> Column:
    """FN9: the body of a ```json fence if there is one, else the whole text."""
    body = F.regexp_extract(_c(x), r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(_c(x))


def robust_json(x, key: str = "device_type") -> Column:
    """FN10 candidates in order: fenced block, the first flat {...} object that has the key and
    parses, from the last { to the last }, last flat object, whole text; the first
    candidate that parses as a JSON object wins (null when none does)."""
    t = _c(x)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    keyed = F.regexp_extract_all(t, F.lit(r'(?s)\{[^{}]*"' + key + r'"[^{}]*\}'), F.lit(0))
    with_key = F.try_element_at(F.filter(keyed, lambda c: F.try_parse_json(c).isNotNull()), F.lit(1))
    tail = F.regexp_extract(t, r"(?s).*(\{.*\})", 1)
    last_obj = F.regexp_extract(t, r"(?s).*(\{[^{}]*\})", 1)
    cands = [fenced, F.coalesce(with_key, F.lit("")), tail, last_obj, t]
    ok = [F.when((c != "") & F.try_parse_json(c).isNotNull() & F.startswith(F.ltrim(c), F.lit("{")), c) for c in cands]
    return F.coalesce(*ok)


def type_catalogue_match(raw, catalogue: Sequence[str]) -> tuple[Column, Column]:
    """FN11: match a raw type against a catalogue: exact -> upper with spaces/hyphens as
    underscores -> case-insensitive -> substring (either way); first catalogue entry wins
    within a class. Returns (matched type or null, match class 0-3 or null)."""
    r = _c(raw)
    norm = F.upper(F.regexp_replace(strip_ws(r), "[ -]+", "_"))
    classes = []
    for cls, pred in enumerate([
        lambda c: r == F.lit(c),
        lambda c: norm == F.lit(c.upper().replace(" ", "_").replace("-", "_")),
        lambda c: F.lower(r) == F.lit(c.lower()),
        lambda c: (F.instr(F.lower(r), c.lower()) > 0) | (F.instr(F.lit(c.lower()), F.lower(r)) > 0) & (F.length(r) > 0),
    ]):
        hit = F.coalesce(*[F.when(pred(c), F.lit(c)) for c in catalogue])
        classes.append((cls, hit))
    matched = F.coalesce(*[h for _, h in classes])
    klass = F.coalesce(*[F.when(h.isNotNull(), F.lit(cls)) for cls, h in classes])
    return matched, klass


def top3_vendors(arr) -> Column:
    """FN12: drop 'unknown'/blank, first 3, default ['unknown']."""
    kept = F.filter(_c(arr), lambda v: v.isNotNull() & (F.lower(strip_ws(v)) != "unknown") & (strip_ws(v) != ""))
    cut = F.slice(kept, 1, 3)
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit("unknown")))


def simple_similarity(a_cols: Sequence[Column], b_cols: Sequence[Column], n_total: int) -> Column:
    """FN13: equal values / number of shared keys (the id counts in the denominator only)."""
    eq = [F.coalesce((x == y).cast("int"), F.lit(0)) for x, y in zip(a_cols, b_cols)]
    total = eq[0]
    for e in eq[1:]:
        total = total + e
    return total / F.lit(float(n_total))


def map_lines(m) -> Column:
    """FN14: map -> 'key: value' lines (keys sorted)."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(m))),
                                    lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), "\n")


def joint_vote(type_a, conf_a, type_b, conf_b) -> tuple[Column, Column]:
    """FN15: agreeing answers -> min(1, round(avg + .05, 4)); otherwise the higher
    confidence wins, a tie goes to the first."""
    ta, ca, tb, cb = _c(type_a), _c(conf_a), _c(type_b), _c(conf_b)
    agree = ta == tb
    t = F.when(agree | (ca >= cb), ta).otherwise(tb)
    c = F.when(agree, F.least(F.lit(1.0), F.round((ca + cb) / 2 + 0.05, 4))) \
        .otherwise(F.when(ca >= cb, ca).otherwise(cb))
    return t, c


def unseen_score(path, key, local, weights=(0.4, 0.4, 0.2)) -> Column:
    """FN16: 1 - (w1*path + w2*key + w3*local), 4 decimals."""
    return F.round(F.lit(1.0) - (F.lit(weights[0]) * _c(path) + F.lit(weights[1]) * _c(key)
                                 + F.lit(weights[2]) * _c(local)), 4)


def tag_query(x, keywords: Mapping[str, Sequence[str]] = PROBLEM_KEYWORDS, custom: str = "CUSTOM_PROBLEM") -> Column:
    """FN18: tags whose keyword occurs as a substring of the lower-cased text; none -> custom."""
    q = F.lower(_c(x))
    tags = F.filter(F.array(*[F.when(F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: F.instr(q, k) > 0), F.lit(tag))
                              for tag, kws in keywords.items()]), lambda t: t.isNotNull())
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(custom)))


def search_keywords(x, sep: str = ";", min_len: int = 5, cut: int = 120, n: int = 3) -> Column:
    """FN19: tokens containing '.', longer than ``min_len - 1``, cut to ``cut`` chars, first
    ``n`` distinct."""
    toks = F.transform(F.split(F.coalesce(_c(x), F.lit("")), sep), strip_ws)
    good = F.filter(toks, lambda t: (F.instr(t, ".") > 0) & (F.length(t) >= min_len))
    return F.slice(F.array_distinct(F.transform(good, lambda t: F.substring(t, 1, cut))), 1, n)


def to_number(x, default: float = 0.0) -> Column:
    """FN21: numeric coercion, default 0."""
    return F.coalesce(_c(x).cast("string").try_cast("double"), F.lit(default))


def basename_no_ext(x) -> Column:
    """FN22: last path segment without its extension."""
    base = F.regexp_extract(_c(x), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


# FIXED VALUES: labelled fields of the fingerprint text (label, column), in order
FINGERPRINT_TEXT_FIELDS = [
    ("Service Distribution", "service-distribution"),
    ("Software Vendors", "sw-vendors"),
    ("Software Products", "sw-products"),
    ("Software Versions", "sw-versions"),
    ("Software Info", "sw-info"),
    ("Hardware Vendors", "hw-vendors"),
    ("Hardware Products", "hw-products"),
    ("Hardware Info", "hw-info"),
    ("OS Vendor", "os-vendor"),
    ("OS Product", "os-product"),
    ("OS Version", "os-version"),
    ("TLS Certificate Subjects", "cert-subjects"),
    ("TLS Certificate Issuers", "cert-issuers"),
    ("TLS Certificate Info", "cert-info"),
    ("TLS Versions", "tls-versions"),
    ("HTTP Tags", "http-tags"),
    ("HTTP Favicon Hashes", "http-favicon-hashes"),
    ("DNS Reverse", "dns-reverse"),
    ("AS Name", "as-name"),
    ("WHOIS Organization", "whois-organization-name"),
    ("Country", "loc-country"),
]
TRUNCATION_SUFFIX = "...[truncated]"
NO_FINGERPRINT_TEXT = "(No fingerprint data available)"


def perspective_text(cols, null_text: str = "nan") -> Column:
    """PRJ12 (null -> 'nan') / PRJ13 (null -> '') : columns joined with '|'."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)) for c in cols])


def fingerprint_text(fields=None, cut: int = 500) -> Column:
    """PRJ14: '- label: value' lines for non-blank fields, values cut to ``cut`` chars plus a
    suffix; no line -> a default text."""
    fields = fields or FINGERPRINT_TEXT_FIELDS
    lines = []
    for label, col in fields:
        v = strip_ws(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")))
        v = F.when(F.length(v) > cut, F.concat(F.substring(v, 1, cut), F.lit(TRUNCATION_SUFFIX))).otherwise(v)
        lines.append(F.when(v != "", F.concat(F.lit(f"- {label}: "), v)))
    body = F.array_join(F.array(*lines), "\n")
    return F.when(body != "", body).otherwise(F.lit(NO_FINGERPRINT_TEXT))


def compact_fingerprint(cols, id_col: str = "ip") -> Column:
    """PRJ15: JSON of the fields that are not the id, not null and not 'nan'/'None'/''."""
    keep = [c for c in cols if c != id_col]
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in keep]), F.array(*[F.col(f"`{c}`").cast("string") for c in keep]))
    return F.to_json(F.map_filter(m, lambda k, v: v.isNotNull() & ~v.isin("nan", "None", "")))


def row_map(cols) -> Column:
    """PRJ23: {column: value} with NaN -> null."""
    vals = []
    for c in cols:
        text = F.col(f"`{c}`").cast("string")
        vals.append(F.when(text != "NaN", text))
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*vals))


def class_label(type_col, vendor_col) -> Column:
    """PRJ22: 'type-vendor' with 'UNK' for a missing vendor."""
    return F.concat_ws("-", F.col(type_col), F.coalesce(F.col(vendor_col), F.lit("UNK")))


# FIXED VALUES: perspective -> key of the cluster report's common patterns
PERSPECTIVE_TO_REPORT_KEY = {
    "as": "autonomous_system",
    "whois": "whois",
    "os": "os",
    "sw": "software",
    "hw": "hardware",
    "sd": "service_distribution",
    "body": "http_tags_favicons",
    "htags": "http_tags_favicons",
    "hfavicons": "http_tags_favicons",
    "certificate": "certificates",
    "dns": "dns",
}


def perspective_descriptions(patterns, cut: int = 500) -> Column:
    """FN17: perspective -> report pattern text (cut to ``cut`` chars) for the perspectives
    whose report key is present in the ``patterns`` map."""
    pm = _c(patterns)
    m = F.map_from_arrays(F.array(*[F.lit(p) for p in PERSPECTIVE_TO_REPORT_KEY]),
                          F.array(*[F.substring(F.element_at(pm, F.lit(k)), 1, cut) for k in PERSPECTIVE_TO_REPORT_KEY.values()]))
    return F.map_filter(m, lambda k, v: v.isNotNull())
