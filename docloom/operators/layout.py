"""Layout grids: character rows of a page as density, headings, breaks, runs and table bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The dark characters of a grid and the limits of its features.
DARK = "█▓"
HEADING_DENSITY, HEADING_DROP = 0.55, 0.6
BREAK_DENSITY, BREAK_ROWS = 0.05, 2
BAND_LEAST, BAND_SPREAD, BAND_ROWS = 0.10, 0.08, 4
RAMP = "█▓▒░ "  # from dark to light
EDGE_ROWS, EDGE_COLUMNS = 5, 2


def _page():
    return Window.partitionBy("doc_id", "page").orderBy("row")


def dark(line: Column) -> Column:
    """The number of dark characters: what the line is shorter by without them."""
    light = line
    for c in DARK:
        light = F.replace(light, F.lit(c), F.lit(""))
    return F.char_length(line) - F.char_length(light)


def density(line: Column) -> Column:
    return F.when(F.char_length(line) > 0, dark(line) / F.char_length(line)).otherwise(0.0)


def layout_headings(grid: DataFrame) -> DataFrame:
    """grid: doc_id, page, row, line. Dense rows before a much thinner one."""
    return _heading_rows(grid).select("doc_id", "page", "row", "density")


def _heading_rows(grid: DataFrame) -> DataFrame:
    rows = grid.withColumn("density", density(F.col("line"))).withColumn("_next", F.lead("density").over(_page()))
    return rows.where((F.col("density") >= HEADING_DENSITY) & (F.col("_next") < HEADING_DROP * F.col("density"))).select("doc_id", "page", "row", "line", F.round("density", 3).alias("density"))


def layout_breaks(grid: DataFrame) -> DataFrame:
    """Runs of at least two nearly empty rows: doc_id, page, row_start, row_end.

    A page's nearly empty rows are gathered as numbers, so that a row's density is worked out once, and numbered there: within a run the row less its place stays."""
    thin = F.when(density(F.col("line")) <= BREAK_DENSITY, F.col("row"))
    rows = grid.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(thin)).alias("_rows")).select("doc_id", "page", F.posexplode("_rows").alias("_n", "row"))
    runs = rows.groupBy("doc_id", "page", (F.col("row") - F.col("_n")).alias("_g")).agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"))
    return runs.where(F.col("row_end") - F.col("row_start") + 1 >= BREAK_ROWS).drop("_g")


def layout_runs(grid: DataFrame) -> DataFrame:
    """Runs of four or more equal characters that aren't blank, the first of each character in a row: doc_id, page, row, char, col, length."""
    found = """aggregate(regexp_extract_all(line, '((.)\\\\2*)', 1), named_struct('at', 0L, 'out', CAST(array() AS ARRAY<STRUCT<char: STRING, col: BIGINT, length: INT>>)), (s, r) ->
        named_struct('at', s.at + char_length(r), 'out', IF(char_length(r) >= 4 AND left(r, 1) <> ' ' AND NOT exists(s.out, o -> o.char = left(r, 1)),
            concat(s.out, array(named_struct('char', left(r, 1), 'col', s.at, 'length', char_length(r)))), s.out)), s -> s.out)"""
    return grid.select("doc_id", "page", "row", F.explode(F.expr(found)).alias("_r")).select("doc_id", "page", "row", "_r.*")


def layout_table_bands(grid: DataFrame) -> DataFrame:
    """Greedy bands of at least four rows whose density stays within a spread of the band's first: doc_id, page, row_start, row_end.

    For each row how far its band would reach, then a fold over the page that takes a band where none is open. A band
    that would start in the last four rows of a page is not looked for."""
    pages = grid.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("row", density(F.col("line")).alias("d")))).alias("_rows"))
    starts = (f"i < size(_rows) - {BAND_ROWS} AND _rows[i].d >= {BAND_LEAST} AND forall(slice(_rows, i + 1, {BAND_ROWS}), y -> abs(y.d - _rows[i].d) <= {BAND_SPREAD})")
    band = "array(named_struct('a', CAST(_rows[s.from].row AS INT), 'b', CAST(_rows[i - 1].row AS INT)))"
    fold = f"""aggregate(sequence(0, size(_rows)), named_struct('from', -1, 'out', CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>)), (s, i) ->
        CASE WHEN s.from >= 0 AND i < size(_rows) AND abs(get(_rows, i).d - _rows[s.from].d) <= {BAND_SPREAD} THEN s
             ELSE named_struct('from', CASE WHEN {starts} THEN i ELSE -1 END, 'out', CASE WHEN s.from >= 0 THEN concat(s.out, {band}) ELSE s.out END) END, s -> s.out)"""
    bands = pages.select("doc_id", "page", F.explode(F.expr(fold)).alias("b"))
    return bands.select("doc_id", "page", F.col("b.a").alias("row_start"), F.col("b.b").alias("row_end"))


def page_summary(grid: DataFrame) -> DataFrame:
    """Pages, rows and mean density of each document."""
    return grid.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("rows"), F.round(F.avg(density(F.col("line"))), 3).alias("mean_density"))


def vertical_edges(grid: DataFrame, least_rows: int = EDGE_ROWS, ramp: str = RAMP, dense: bool = False) -> DataFrame:
    """doc_id, page, col, row_start, row_end: the longest run of edge characters down each column, the first on ties, of at least so many rows.

    Edges are all characters of the ramp but the lightest and the blank, or only the darker half of the ramp (dense). A line that doesn't reach a column has none there.
    The runs are islands of consecutive rows within a column, folded page by page."""
    edges = ramp[: max(1, len(ramp) // 2)] if dense else "".join(sorted(set(ramp) - {ramp[-1], " "}))
    blank = edges == ""
    listed = F.array_sort(F.collect_list(F.struct("row", F.translate(F.coalesce("line", F.lit("")), edges + "#", "#" * len(edges) + ("#" if "#" in edges else " ")).alias("l"))))
    pages = grid.groupBy("doc_id", "page").agg(listed.alias("_p"), F.max(F.char_length("line")).alias("_w")).where((F.col("_w") > 0) & F.lit(not blank))
    marks = pages.select("doc_id", "page", "_p", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("col"))
    hit = "filter(_p, x -> substring(x.l, col + 1, 1) = '#')"
    islands = f"""aggregate({hit}, CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>), (s, x) -> IF(size(s) > 0 AND element_at(s, -1).b = x.row - 1,
        concat(slice(s, 1, size(s) - 1), array(named_struct('a', element_at(s, -1).a, 'b', CAST(x.row AS INT)))), concat(s, array(named_struct('a', CAST(x.row AS INT), 'b', CAST(x.row AS INT))))))"""
    runs = marks.select("doc_id", "page", "col", F.explode(F.expr(islands)).alias("_g")).select("doc_id", "page", "col", F.col("_g.a").alias("row_start"), F.col("_g.b").alias("row_end"))
    longest = F.max(F.struct((F.col("row_end") - F.col("row_start") + 1).alias("n"), (-F.col("row_start")).alias("up"), "row_end")).alias("b")
    best = runs.groupBy("doc_id", "page", "col").agg(longest).where(F.col("b.n") >= least_rows)
    return best.select("doc_id", "page", "col", (-F.col("b.up")).alias("row_start"), F.col("b.row_end").alias("row_end"))


def layout_sparse_tables(grid: DataFrame, least_rows: int = EDGE_ROWS, least_columns: int = EDGE_COLUMNS, ramp: str = RAMP, dense: bool = False) -> DataFrame:
    """Tables of which only the borders show: doc_id, page, row_start, row_end, columns.

    A sweep over a page's edges from left to right: each joins the first band whose common rows it shares, which shrinks to what all have in common, or opens one. Bands of
    enough edges and rows are tables. The state is a page's bands, at most as many as its columns."""
    edges = vertical_edges(grid, least_rows, ramp, dense).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("col", F.col("row_start").cast("int").alias("a"), F.col("row_end").cast("int").alias("b")))).alias("_e"))
    shared = "greatest(x.a, e.a) <= least(x.b, e.b)"
    sweep = f"""aggregate(_e, CAST(array() AS ARRAY<STRUCT<a: INT, b: INT, n: INT>>), (s, e) -> CASE WHEN exists(s, x -> {shared})
        THEN transform(s, (x, i) -> IF(i + 1 = array_position(transform(s, x -> {shared}), true), named_struct('a', greatest(x.a, e.a), 'b', least(x.b, e.b), 'n', x.n + 1), x))
        ELSE concat(s, array(named_struct('a', e.a, 'b', e.b, 'n', 1))) END)"""
    bands = edges.select("doc_id", "page", F.explode(F.expr(sweep)).alias("t")).where(f"t.n >= {least_columns} AND t.b - t.a + 1 >= {least_rows}")
    return bands.select("doc_id", "page", F.col("t.a").alias("row_start"), F.col("t.b").alias("row_end"), F.col("t.n").alias("columns"))


def page_features(grid: DataFrame, ramp: str = RAMP) -> DataFrame:
    """All features of each page: doc_id, page, rows, cols, density, headings (row, density, width_ratio), tables (row_start, row_end, columns), breaks (row, blank_rows), placeholders (row, col, pattern).

    Tables are the dense bands and the sparse ones, merged where they overlap or touch. A document without lines has no rows here."""
    from .reports import merge_hints, width_ratio

    listed = lambda df, name, *cols: df.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    pages = grid.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("rows"), F.max(F.char_length("line")).alias("cols"), F.round(F.sum(dark(F.col("line"))) / F.greatest(F.sum(F.char_length("line")), F.lit(1)), 3).alias("density"))
    heads = _heading_rows(grid).withColumn("width_ratio", F.round(width_ratio(F.col("line"), ramp[-1]), 3))
    dense = layout_table_bands(grid).withColumn("columns", F.lit(0))
    tables = merge_hints(dense.unionByName(layout_sparse_tables(grid, ramp=ramp)))
    breaks = layout_breaks(grid).select("doc_id", "page", F.col("row_start").alias("row"), (F.col("row_end") - F.col("row_start") + 1).alias("blank_rows"))
    marks = layout_runs(grid).select("doc_id", "page", "row", "col", F.expr("repeat(char, length)").alias("pattern"))
    out = pages
    for df, name, cols in ((heads, "headings", ("row", "density", "width_ratio")), (tables, "tables", ("row_start", "row_end", "columns")), (breaks, "breaks", ("row", "blank_rows")), (marks, "placeholders", ("row", "col", "pattern"))):
        out = out.join(listed(df, name, *cols), ["doc_id", "page"], "left")
    return out


_LISTS = ("headings", "tables", "breaks", "placeholders")


def _size(name: str) -> Column:
    return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))


def document_features(pages: DataFrame) -> DataFrame:
    """page_features by document: doc_id, page_count, the total of each kind, average_density, pages (array in order)."""
    sizes = [_size(n).cast("long").alias(n) for n in _LISTS]
    page = F.struct("page", "rows", "cols", "density", *sizes)
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), *[F.sum(_size(n)).cast("long").alias(n) for n in _LISTS], F.round(F.avg("density"), 3).alias("average_density"),
                                       F.array_sort(F.collect_list(page)).alias("pages"))


def document_summary(documents: DataFrame, fmt: str = "text") -> DataFrame:
    """document_features as doc_id, summary: some lines of text, or a JSON object with all counts."""
    if fmt not in ("text", "json"):
        raise ValueError(f"unknown format of a summary: {fmt}")
    if fmt == "json":
        totals = F.struct(*[F.col(n).alias(n if n != "breaks" else "section_breaks") for n in _LISTS]).alias("totals")
        return documents.select("doc_id", F.to_json(F.struct("page_count", totals, "average_density", "pages")).alias("summary"))
    head = F.format_string("Document: %d pages, avg density=%.2f\nTotals — headings=%d tables=%d section_breaks=%d placeholders=%d\n\n", "page_count", "average_density", *_LISTS)
    line = lambda p: F.format_string("Page %d: H=%d T=%d S=%d P=%d d=%.2f", p["page"], *[p[n] for n in _LISTS], p["density"])
    return documents.select("doc_id", F.concat(head, F.array_join(F.transform("pages", line), "\n")).alias("summary"))


def page_summary_text(pages: DataFrame, most: int = 10) -> DataFrame:
    """page_features as doc_id, page, summary: size, density, and up to so many lines for each kind of feature."""
    lines = {"headings": ("Headings detected", lambda x: F.format_string("  row=%3d density=%.2f width=%.2f", x["row"], x["density"], x["width_ratio"])),
             "tables": ("Tables detected", lambda x: F.format_string("  rows %d-%d", x["row_start"], x["row_end"])),
             "breaks": ("Section breaks", lambda x: F.format_string("  row=%d blank_rows=%d", x["row"], x["blank_rows"])),
             "placeholders": ("Placeholders", lambda x: F.format_string("  row=%d col=%d pattern='%s'", x["row"], x["col"], F.left(x["pattern"], F.lit(20))))}
    parts = [F.array(F.format_string("Grid: %dx%d, density=%.2f", "rows", "cols", "density"))]
    for name, (title, line) in lines.items():
        some = F.coalesce(F.transform(F.slice(name, 1, most), line), F.array().cast("array<string>"))
        parts.append(F.concat(F.array(F.format_string(title + ": %d", _size(name))), some))
    return pages.select("doc_id", "page", F.array_join(F.concat(*parts), "\n").alias("summary"))
