"""Statistics tables out of a table of web pages, as native expressions.

A page is one row. Rows and cells are cut with linear patterns and higher-order
functions, so a long page needs no Python worker and no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seasonlake.functions.text import canonical_code, name_key, parse_number

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain(fragment: Column) -> Column:
    """Text of an HTML fragment: tags dropped, entities resolved, trimmed."""
    out = F.regexp_replace(fragment, "<[^>]*>", "")
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _one(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _marked(tag: str, css: str) -> str:
    return rf'(?s)<{tag}\b[^>]*class="[^"]*{css}[^"]*"[^>]*>'


def marked_rows(
    pages: DataFrame,
    html: str = "html",
    row_class: str = "TableBase-bodyTr",
    number_class: str = "TableBase-bodyTd--number",
    name_class: str = "CellPlayerName--long",
    team_class: str = "CellPlayerName-team",
    unit_class: str = "TeamName",
) -> DataFrame:
    """Body rows of a class-marked table; the last two numbers are points and per-game.

    Rows with fewer than two numbers, with an unreadable one, or without a link are
    skipped. A person's id is in the link and the team in a span; a team row takes
    its code from the link.
    """
    keep = [c for c in pages.columns if c != html]
    row = _all(F.col(html), _marked("tr", row_class) + r"(.*?)</tr>")
    df = pages.select(*keep, F.posexplode(row).alias("row_no", "_row"))
    cells = _all(F.col("_row"), _marked("td", number_class) + r"(.*?)</td>")
    df = df.withColumn("_n", cells).where(F.size("_n") >= 2)
    df = df.withColumn("points", parse_number(plain(F.element_at("_n", -1 - 1)))).withColumn(
        "fppg", parse_number(plain(F.element_at("_n", -1)))
    ).where(F.col("points").isNotNull() & F.col("fppg").isNotNull())
    person = _one(F.col("_row"), _marked("span", name_class) + r".*?(<a\b.*?</a>)")
    is_person = F.regexp_like("_row", F.lit(_marked("span", name_class)))
    unit = _one(F.col("_row"), _marked("span", unit_class) + r".*?(<a\b.*?</a>)")
    df = df.withColumn("_a", F.when(is_person, person).otherwise(unit)).where(F.col("_a").isNotNull())
    code = _one(F.col("_a"), r'href="[^"]*/nfl/teams/([A-Z]+)/')
    span = plain(_one(F.col("_row"), _marked("span", team_class) + r"(.*?)</span>"))
    df = df.withColumn("_person", is_person).withColumn("_code", code)
    df = df.where(F.col("_person") | F.col("_code").isNotNull())
    entity = _one(F.col("_a"), r'href="[^"]*/nfl/players/(\d+)/').cast("long")
    return df.select(
        *keep, "row_no",
        F.when(F.col("_person"), entity).alias("entity_id"),
        plain(F.col("_a")).alias("name"),
        F.when(F.col("_person"), span).otherwise(canonical_code(F.col("_code"))).alias("team"),
        "points", "fppg",
    )


def header_rows(
    pages: DataFrame,
    html: str = "html",
    last_header: str = "FPts",
    is_team: Column | None = None,
) -> DataFrame:
    """Rows below the header that ends in ``last_header``, innermost table only.

    Text after each opening tag and before the first closing one is exactly an
    innermost table. Rows with fewer than three cells or a bad number are skipped.
    """
    keep = [c for c in pages.columns if c != html]
    pieces = F.split(F.col(html), r"<table\b")
    opened = F.slice(pieces, F.lit(2), F.size(pieces))
    inner = F.transform(
        F.filter(opened, lambda p: F.contains(p, F.lit("</table>"))),
        lambda p: F.element_at(F.split(p, "</table>"), 1),
    )
    rows = F.transform(
        inner,
        lambda body: F.transform(
            _all(body, r"(?s)<tr\b[^>]*>(.*?)</tr>"),
            lambda r: F.transform(_all(r, r"(?s)<t[dh]\b[^>]*>(.*?)</t[dh]>"), plain),
        ),
    )

    def header_at(table: Column) -> Column:
        ends = F.transform(
            table, lambda cells: F.coalesce(F.try_element_at(cells, F.lit(-1)) == last_header, F.lit(False))
        )
        return F.array_position(ends, F.lit(True))

    df = pages.select(*keep, rows.alias("_tables"))
    df = df.withColumn(
        "_t", F.try_element_at(F.filter("_tables", lambda table: header_at(table) > 0), F.lit(1))
    ).where(F.col("_t").isNotNull())
    below = F.slice("_t", (header_at(F.col("_t")) + 1).cast("int"), F.size("_t"))
    df = df.select(*keep, F.posexplode(below).alias("row_no", "_c")).where(F.size("_c") >= 3)
    df = df.withColumn("points", parse_number(F.element_at("_c", -1))).where(F.col("points").isNotNull())
    name, team = F.element_at("_c", 2), F.element_at("_c", 3)
    unit = is_team if is_team is not None else F.lit(False)
    return df.select(
        *keep, "row_no",
        F.when(~unit, name_key(name)).alias("merge_name"),
        name.alias("name"),
        F.when(unit, canonical_code(name)).otherwise(team).alias("team"),
        "points",
    )


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every link of a page: its place, target and text."""
    keep = [c for c in pages.columns if c != html]
    pattern = r'(?s)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(
        _all(F.col(html), pattern, 1).alias("href"), _all(F.col(html), pattern, 2).alias("label")
    )
    df = pages.select(*keep, F.posexplode(pairs).alias("link_no", "l"))
    return df.select(*keep, "link_no", F.col("l.href").alias("href"), plain(F.col("l.label")).alias("label"))


def with_metadata(pages: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Stamp parsed rows with the position, scoring and season of their page."""
    return parsed.join(pages, key)
