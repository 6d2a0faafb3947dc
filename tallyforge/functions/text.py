"""Text: profiles, segmentation, classes, label cleaning, truncation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .numeric import parse_accounting

# Label cleaning rules, in order.
CLEAN_RULES = (
    (r"\(in \$.*?\)", ""),
    (r"\(in thousands.*?\)", ""),
    (r"\$", ""),
    (r"\(.*?000.*?\)", ""),
    (r"[^\w\s&]", " "),
    (r"\s+", " "),
    (r"^\s+|\s+$", ""),
    (r"\b(and|&)\b", "and"),
    (r"\brd\b", "research and development"),
    (r"\br&d\b", "research and development"),
    (r"\bsga\b", "selling general and administrative"),
    (r"\bsg&a\b", "selling general and administrative"),
    (r"\bcogs\b", "cost of goods sold"),
)
LEADING_WORDS = ("total", "net", "gross", "consolidated")
PROFILE_WORDS = ("revenue", "income", "assets", "liabilities", "equity", "earnings", "profit", "loss", "cash", "flow", "million", "billion", "thousand")
HEADING_WORDS = ("FORM", "REPORT", "TESLA", "ITEM", "PART", "SECTION")
MONEY_WORDS = ("$", "MILLION", "BILLION", "REVENUE", "INCOME")
STRUCTURE_WORDS = ("TABLE", "FIGURE", "EXHIBIT")

#: Financial values as (name, pattern), and (name, pattern, scale); group 1 is the number.
CONTEXT_PATTERNS = (
    ("revenue", r"(?:revenue|sales|income)[^\d]*(\$?\d+(?:,\d{3})*(?:\.\d+)?)"),
    ("net_income", r"(?:net income|profit|earnings)[^\d]*(\$?\d+(?:,\d{3})*(?:\.\d+)?)"),
    ("assets", r"(?:total assets|assets)[^\d]*(\$?\d+(?:,\d{3})*(?:\.\d+)?)"),
    ("cash", r"(?:cash|cash and equivalents)[^\d]*(\$?\d+(?:,\d{3})*(?:\.\d+)?)"),
)
VALUE_PATTERNS = (
    ("currency_millions", r"\$(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:million|mil\b)", 1e6),
    ("currency_billions", r"\$(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:billion|bil\b)", 1e9),
    ("currency_exact", r"\$(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", 1.0),
    ("percentage", r"(\d{1,3}(?:\.\d{1,2})?)%", 1.0),
    ("large_numbers", r"\b(\d{1,3}(?:,\d{3})+)\b", 1.0),
)

#: A shorter classifier's words (T10): no sections, cash as money, no structures.
HEADING_WORDS_SHORT = HEADING_WORDS[:-1]
MONEY_WORDS_SHORT = (*MONEY_WORDS, "CASH")
SPACE = r"\s+"
#: Characters that count as white space at the ends of a text: those of ASCII, its four separators, and Unicode's.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(t):
    """White space of all kinds goes at both ends; trim() takes blanks only."""
    return F.btrim(t, F.lit(WHITE))


def long_enough(t, least: int):
    """at least ``least`` characters between the white space at its ends."""
    return F.length(strip(t)) >= least


def signature(t, size: int = 400):
    """The first ``size`` characters in lower case, stripped."""
    return strip(F.substring(F.lower(t), 1, size))


def words(t):
    """Words of a text as Python's split() gives them; none for blank text."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), SPACE), lambda w: w != "")


def tokens(t, stop=()):
    """Lowered runs of letters, marks and digits of any script, without the words in ``stop``; none for null."""
    out = F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.filter(out, lambda w: ~w.isin(*stop)) if stop else out


def n_words(t):
    return F.size(words(t))


def clean_label(label, rules=CLEAN_RULES, expand_first: bool = True):
    """T1. Abbreviations with an ampersand are expanded first; ``expand_first=False`` keeps the rules' own order, by which '&' between letters has become 'and' before."""
    own = list(rules)
    if expand_first:
        own = [r for r in own if "&" in r[0] and "(and" not in r[0] and r[0].startswith(r"\b")] + own
    out = strip(F.lower(F.coalesce(label, F.lit(""))))
    return strip(reduce(lambda t, r: F.regexp_replace(t, "(?i)" + r[0], r[1]), own, out))


def clean_phrase(text):
    """Punctuation at the ends, repeated blanks and leading qualifiers go, one qualifier after another."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"^[^\w\s]+|[^\w\s]+$", "")
    t = F.regexp_replace(t, SPACE, " ")
    for w in LEADING_WORDS:
        t = F.regexp_replace(t, rf"^{w}\s+", "")
    return strip(t)


def truncate(t, size: int = 1500):
    """P16."""
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def route(text, ocr=None, least: int = 50, least_ocr: int = 10):
    """Which extraction is accepted."""
    ocr = F.lit("") if ocr is None else ocr
    return F.when(F.length(strip(text)) > least, "pdfplumber").when(F.length(strip(ocr)) > least_ocr, "tesseract_ocr").otherwise("failed")


def _has(upper, needles):
    return reduce(lambda a, b: a | b, (upper.contains(n) for n in needles))


def classify(text, headings=HEADING_WORDS, money=MONEY_WORDS, structures=STRUCTURE_WORDS, font_size=None):
    """T9 (T10 with the short lexicons and ``structures=()``; T11 with ``font_size``)."""
    up, bare = F.upper(text), strip(text)
    shout = (F.upper(bare) == bare) & (F.lower(bare) != bare)
    out = F.when((F.length(bare) < 100) & _has(up, headings), "heading")
    if structures:
        out = out.when((F.length(bare) < 50) & shout, "subheading")
    out = out.when(_has(up, money), "text_block").when(bare.rlike(r"^\w+\.\s") | text.contains("•"), "list")
    if structures:
        out = out.when(_has(up, structures), "structured_content")
    out = out.otherwise("paragraph")
    if font_size is not None:
        s = F.coalesce(font_size, F.lit(11.0))
        out = F.when(s > 14, "heading").when(s > 12, "subheading").otherwise(out)
    return out


def pack(parts, limit: int = 2000, joiner: str = "\n\n"):
    """Greedy packing of an array of parts into chunks of at most ``limit`` characters; a longer part stays whole."""
    done = F.array().cast("array<string>")
    start = F.struct(done.alias("done"), F.lit("").alias("held"))

    def step(acc, p):
        fits = F.length(acc["held"]) + F.length(p) + len(joiner) <= limit
        return F.when(acc["held"] == "", F.struct(acc["done"].alias("done"), p.alias("held"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["held"], F.lit(joiner), p).alias("held"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["held"])).alias("done"), p.alias("held"))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))))


def paragraphs(text, separator: str = "\n\n", least: int = 15, limit: int = 2000, joiner: str = ""):
    """Paragraphs of at least ``least`` characters; longer ones than ``limit`` are packed from sentences.

    A sentence ends at a full stop with a blank, which is lost between sentences of a chunk unless ``joiner`` gives it back.
    """
    parts = F.filter(F.transform(F.split(text, separator), strip), lambda p: F.length(p) >= least)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(F.transform(pack(F.split(p, r"(?<=\.) "), limit, joiner), strip))))


def _moments(xs):
    """struct(n, mean, std) of an array of doubles in one pass; population deviation, 0 for none."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    n1 = lambda a: F.greatest(a["n"], F.lit(1.0))
    return F.aggregate(
        xs, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.struct(a["n"].cast("int").alias("n"), (a["s"] / n1(a)).alias("mean"), F.sqrt(F.greatest(a["q"] / n1(a) - (a["s"] / n1(a)) * (a["s"] / n1(a)), F.lit(0.0))).alias("std")),
    )


def profile_folds(text) -> dict:
    """The parts of ``profile`` that other parts share: a frame that holds them as columns has each computed once."""
    t = F.coalesce(text, F.lit(""))
    lengths = lambda p: F.transform(F.filter(F.split(t, p), lambda s: s.rlike(r"\S")), lambda s: n_words(s).cast("double"))
    return {"words": n_words(t), "sentences": _moments(lengths("[.!?]+")), "paragraphs": _moments(lengths("\n\n"))}


def profile(text, lexicon=PROFILE_WORDS, folds: dict | None = None) -> dict:
    """The features of a page's text, by name. ``folds``: columns that hold ``profile_folds``."""
    t = F.coalesce(text, F.lit(""))
    folds = folds or profile_folds(text)
    chars, n, sent, para = F.length(t), folds["words"], folds["sentences"], folds["paragraphs"]
    lines = F.size(F.split(t, "\n"))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("int")
    finds = F.regexp_count(F.lower(t), F.lit(r"\b(" + "|".join(lexicon) + r")\b")).cast("int")
    one = lambda x: F.greatest(x, F.lit(1))
    return {
        "char_count": chars, "word_count": n, "line_count": lines, "avg_words_per_line": n / one(lines),
        "numeric_ratio": count("[0-9]") / one(chars), "special_char_ratio": count(r"[^\p{L}\p{N}_\s]") / one(chars), "uppercase_ratio": count("[A-Z]") / one(chars),
        "financial_keywords": finds, "financial_density": finds / one(n),
        "currency_patterns": count(r"\$[0-9,]+(?:\.[0-9]{2})?"), "percentage_patterns": count(r"[0-9]+(?:\.[0-9]+)?%"),
        "sentence_count": sent["n"], "avg_sentence_length": sent["mean"], "sentence_length_std": sent["std"],
        "paragraph_count": para["n"], "avg_paragraph_length": para["mean"], "content_density": n / one(chars),
    }


def financial_values(text, contextual=CONTEXT_PATTERNS, general=VALUE_PATTERNS):
    """Array of (pattern_type, context, idx, value, original_text) of all matches of each pattern; patterns overlap, each emits its own.

    Contextual patterns read the lowered text, up to its last digit: they end with a number. Texts without a digit are not searched. Case, blanks and
    word ends are those of Unicode. ``idx`` counts a pattern's matches.
    """
    digit = F.lit(r"(?U)\d")

    def found(t, pattern, kind, context, scale):
        p = "(?iU)" + pattern
        return F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda m, i: F.struct(F.lit(kind).alias("pattern_type"), F.lit(context).alias("context"), i.alias("idx"), (parse_accounting(F.regexp_extract(m, p, 1)) * scale).alias("value"), m.alias("original_text")))

    to_last = lambda t: F.substring(t, F.lit(1), F.length(t) - F.regexp_instr(F.reverse(t), digit) + 1)
    each = F.transform(F.array(to_last(F.lower(text))), lambda low: F.concat(*[found(low, p, "contextual", name, 1.0) for name, p in contextual]))[0]
    each = F.concat(each, *[found(text, p, name, "unknown", k) for name, p, k in general])
    return F.when(F.regexp_like(text, digit), F.filter(each, lambda m: m["value"].isNotNull()))


def clean_filename(name):
    """Characters that file systems refuse become one underscore."""
    return strip(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), "_+", "_"))


def document_attributes(name, companies: list[tuple[str, str, str]], default_year: str = "2024"):
    """struct(doc_id, company, fiscal_year) of a file name. ``companies``: (substring, company, short id), first hit wins."""
    low = F.lower(name)
    plain = F.regexp_replace(F.regexp_replace(low, " ", "_"), "-", "_")
    years = F.regexp_extract_all(name, F.lit(r"20[0-9]{2}"), F.lit(0))
    year = F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(default_year))
    company, short = F.lit("Unknown Company"), F.lit(None).cast("string")
    for key, full, brief in reversed(companies):
        company, short = F.when(low.contains(key), full).otherwise(company), F.when(low.contains(key), brief).otherwise(short)
    doc_id = F.when(short.isNull() & (F.size(years) > 0), plain).otherwise(F.concat_ws("_", F.coalesce(short, plain), year))
    return F.struct(doc_id.alias("doc_id"), company.alias("company"), year.alias("fiscal_year"))


def table_file(name):
    """struct(method, page, table_id) of a table's file name; nulls if it is none."""
    p = r"_(camelot_lattice|camelot_stream|pdfplumber)_p([0-9]+)_t([0-9]+)"
    g = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    return F.struct(g(1).alias("method"), g(2).cast("int").alias("page"), g(3).cast("int").alias("table_id"))


def sections(markdown, level: int = 2):
    """Array of (title, content) of the parts under headings of ``level`` marks; what stands before the first has a null title."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(markdown, F.lit(""))), rf"\n#{{{level}}} ")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = lambda p, i: F.when(i == 0, p).when(p.contains("\n"), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise("")
    each = F.transform(parts, lambda p, i: F.struct(F.when(i > 0, strip(F.substring_index(p, "\n", 1))).alias("title"), strip(body(p, i)).alias("content")))
    return F.filter(each, lambda s: s["title"].isNotNull() | (s["content"] != ""))


def any_sections(markdown, first: str = "Introduction"):
    """S17, any heading: array of (title, content) of the parts under lines that begin with '#'; parts of white space only are left out.

    Content keeps its line ends. What stands before the first heading is titled ``first``.
    """
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(markdown, F.lit("")), F.lit("\n")), "\n#")
    # the line end that opens the next heading was its own line's: it is given back
    body = lambda p, i, n: F.concat(F.when(i == 0, F.substring(p, 2, 1 << 30)).when(p.contains("\n"), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(""), F.when((i < n - 1) & p.contains("\n"), F.lit("\n")).otherwise(""))
    section = lambda p, i, n: F.struct(F.when(i == 0, F.lit(first)).otherwise(strip(F.btrim(F.substring_index(p, "\n", 1), F.lit("# ")))).alias("title"), body(p, i, n).alias("content"))
    each = F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: section(p, i, F.size(ps))))[0]  # split once
    return F.filter(each, lambda s: strip(s["content"]) != "")
