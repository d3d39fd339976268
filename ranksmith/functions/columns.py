"""Scalar functions as Column expressions: flags, identifiers, markup repair, LaTeX keys, tokens, number and symbol classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda's variable is bound, where an expression that a
    higher-order function mentions inside its lambda is computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def union_flags(*flags: Column | str) -> Column:
    """The distinct characters of several flag strings, sorted; null where there are none."""
    letters = F.split(F.concat(*[F.coalesce(_col(f), F.lit("")) for f in flags]), "")
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(letters, lambda x: x != ""))), ""), F.lit(""))


def retrievable(issue: Column | str) -> Column:
    return ~F.coalesce(F.contains(_col(issue), F.lit("d")), F.lit(False))


def clean_id(c: Column | str) -> Column:
    """Trimmed; empty and the words none, nan, null in any case are null."""
    t = strip(c)
    return F.when(~F.lower(t).isin("", "none", "nan", "null"), t)


# Fixed patterns of the markup's known defects, in the order of their repair.
MARKUP_REPAIRS = (
    (r"^\s*<\?xml[^>]*\?>", ""),
    (r"""\salttext=(?:"[^"]*"|'[^']*')""", ""),
    (r"</?mpadded\b[^>]*>", ""),
    (r"&(?!#\d+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)", "&amp;"),
    (r"<(?![A-Za-z/!?])", "&lt;"),
)


def sanitize(xml: Column | str) -> Column:
    out = strip(xml)
    for pattern, by in MARKUP_REPAIRS:
        out = F.regexp_replace(out, pattern, by)
    return out


def unescape(c: Column | str) -> Column:
    """The five predefined entities and the non-breaking space; ``udfs.html_unescape`` knows them all."""
    out = _col(c)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def alttext(slt: Column | str) -> Column:
    """The double-quoted alttext attribute, null where there is none."""
    return F.when(F.regexp_like(_col(slt), F.lit('alttext="[^"]*"')), F.regexp_extract(_col(slt), 'alttext="([^"]*)"', 1))


def _unwrapped(c: Column | str) -> Column:
    return F.regexp_replace(unescape(c), r"(?U)(?<!\\)%\s*", "")


def latex_key(c: Column | str) -> Column:
    """LaTeX without line-break comments, white space and braces."""
    return F.regexp_replace(_unwrapped(c), r"(?U)[\s{}]+", "")


# Fixed pattern: LaTeX that changes only the look of a formula.
COSMETIC = r"\\(left|right|big|Big|bigg|Bigg)(?![a-zA-Z])|\\(displaystyle|textstyle|limits|nolimits|mathrm|operatorname|rm|text|mbox)(?![a-zA-Z])|\\[,;:! ]|\\q?quad(?![a-zA-Z])|~|&"

# Fixed table: commands with the same meaning.
SYNONYMS = {r"\le": r"\leq", r"\ge": r"\geq", r"\ne": r"\neq", r"\to": r"\rightarrow", r"\gets": r"\leftarrow", r"\dots": r"\ldots", r"\cdots": r"\ldots"}


def plain_latex(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_unwrapped(c), COSMETIC, " "), r"(?U)[\s{}]+", "")
    return F.regexp_replace(bare, "[.,;:]+$", "")


def latex_symbols(c: Column | str) -> Column:
    """Commands, letters and digits in order, synonyms unified."""
    found = F.regexp_extract_all(F.regexp_replace(_unwrapped(c), COSMETIC, " "), F.lit(r"(\\[a-zA-Z]+|[A-Za-z0-9])"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), t))


def mismatch_bucket(latex: Column | str, alt: Column) -> Column:
    """How far the LaTeX in the markup is from the row's own."""
    return (
        F.when(alt.isNull(), "no_alttext")
        .when(latex_key(alt) == latex_key(latex), "match")
        .when(plain_latex(alt) == plain_latex(latex), "cosmetic")
        .when(latex_symbols(alt) == latex_symbols(latex), "same_symbols")
        .otherwise("different")
    )


def latex_tokens(c: Column | str) -> Column:
    """Commands, single letters or digits, and any other character but white space and braces."""
    return F.regexp_extract_all(_col(c), F.lit(r"(?U)(\\[a-zA-Z]+|[A-Za-z0-9]|[^\s{}])"), F.lit(1))


def with_bigrams(symbols: Column | str) -> Column:
    """The symbols, then each neighbouring pair joined by a space."""
    empty = F.array().cast("array<string>")
    pairs = lambda s: F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return bound(_col(symbols), lambda s: F.when(F.size(s) > 1, F.concat(s, pairs(s))).otherwise(F.when(s.isNotNull(), F.concat(s, empty))))


def text_tokens(c: Column | str) -> Column:
    """ASCII letters and digits, lower-cased: the stand-in tokeniser for plain text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def trigrams(c: Column | str) -> Column:
    """Distinct character triples; a shorter string is one short gram."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 2)), lambda i: F.substring(s, i, F.lit(3)))
    return F.array_distinct(bound(_col(c), cut))


def formula_text(c: Column | str) -> Column:
    """LaTeX without sizing commands, dollar signs and white space, for trigram similarity."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\\left|\\right|\s+|\$", "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def number_bucket(symbol: Column | str) -> Column:
    s = _col(symbol)
    return (
        F.when(F.regexp_like(s, F.lit(r"(?U)^\d+$")), F.concat(F.lit("<int"), F.least(F.length(s), F.lit(5)).cast("string"), F.lit(">")))
        .when(F.regexp_like(s, F.lit(r"(?U)^\d*[.,]\d+$")), "<decimal>")
        .otherwise("<number>")
    )


def variable_class(symbol: Column | str) -> Column:
    """The alphabet a single-letter variable belongs to; e, i and pi are constants."""
    s = _col(symbol)
    one = (F.length(s) == 1) & ~s.isin("e", "i", "π", "ς")
    return F.when(one & s.between("a", "z"), "latin_lower").when(one & s.between("A", "Z"), "latin_upper").when(one & s.between("α", "ω"), "greek_lower").when(one & s.between("Α", "Ω"), "greek_upper")


def number_class(symbol: Column | str) -> Column:
    s = _col(symbol)
    return F.when(F.regexp_like(s, F.lit("^[0-9]+$")) & ~s.isin("0", "1"), F.concat(F.lit("int"), F.length(s).cast("string")))


def post_type(c: Column | str) -> Column:
    return F.lower(strip(c))


def safe_run_id(c: Column | str) -> Column:
    """Every character a run id may not hold becomes a hyphen."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_-]+", "-")
