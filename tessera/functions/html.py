"""HTML fragment extraction with regular expressions (P9, P10). JVM-side.

Not an HTML parser: it targets well-formed fragments of known shape, the way
the landed pages are produced, and stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: entity replacements, applied in this order (&amp; last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def element_pattern(tag: str, attr: str | None = None, value: str | None = None) -> str:
    """(?is)<tag ...attr="value"...>(inner)</tag> — first match, lazy inner."""
    cond = f'[^>]*{attr}="{value}"' if attr else ""
    return f"(?is)<{tag}{cond}[^>]*>(.*?)</{tag}>"


def strip_tags(html) -> Column:
    """Drop script/style blocks and comments, then every tag (text nodes are
    concatenated as an HTML text extractor does)."""
    x = F.regexp_replace(_c(html), r"(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(x, r"<[^>]*>", "")


def unescape(text) -> Column:
    x = _c(text)
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def element_text(html, tag: str, attr: str | None = None, value: str | None = None) -> Column:
    """Whitespace-collapsed text of the first matching element; '' if absent."""
    inner = F.regexp_extract(_c(html), element_pattern(tag, attr, value), 1)
    return F.trim(F.regexp_replace(unescape(strip_tags(inner)), r"\s+", " "))


def items(html, container: str, item: str) -> Column:
    """P10 rows: inner HTML of each ``item`` element in the first ``container``."""
    inner = F.regexp_extract(_c(html), element_pattern(container), 1)
    return F.regexp_extract_all(inner, F.lit(f"(?is)<{item}[^>]*>(.*?)</{item}>"), 1)


def cells(row_html, cell: str = "td") -> Column:
    """Cells of one row, tags stripped and trimmed."""
    raw = F.regexp_extract_all(row_html, F.lit(f"(?is)<{cell}[^>]*>(.*?)</{cell}>"), 1)
    return F.transform(raw, lambda c: F.trim(unescape(strip_tags(c))))


def table_rows(html, table_class: str, picks: dict[str, int]) -> Column:
    """P10: rows of ``table.<class> tbody`` as an array of structs of picked cells."""
    table = F.regexp_extract(_c(html), f'(?is)<table[^>]*class="[^"]*{table_class}[^"]*"[^>]*>(.*?)</table>', 1)
    body = F.regexp_extract(table, r"(?is)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)

    def to_struct(r):
        cs = cells(r)
        return F.struct(*[F.get(cs, i).alias(name) for name, i in picks.items()])
    return F.transform(rows, to_struct)


def link_href(item_html) -> Column:
    return F.regexp_extract(_c(item_html), r'(?is)href="([^"]*)"', 1)
