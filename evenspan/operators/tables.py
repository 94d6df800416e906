"""LaTeX tables of results, as frames of lines: a column for each language, rows in blocks, one block for each number of segments.

Cells are aggregated rows (a line for each run, position and statistic), so that a table is as long as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import latex_escape, stars

ROW_END = r" \\"


def _label(model: str) -> str:
    return model.lower().replace("/", "-").replace(" ", "-").replace("_", "-")


def two_places(value: Column, p: Column | None = None) -> Column:
    """Two decimals, and the stars of a p-value."""
    text = F.format_string("%.2f", value)
    return text if p is None else F.concat(text, F.coalesce(stars(p), F.lit("")))


def grid(cells: DataFrame, columns: list[str], title: str, caption: str, label: str, named_rows: bool = True) -> DataFrame:
    """line_no, line of a table. ``cells``: block (a number, shown once), place (of the row in its block), name (of the row), column, text.
    A cell that there isn't is a dash. Blocks stand in order, with a gap between them."""
    wide = cells.groupBy("block", "place", "name").pivot("column", columns).agg(F.first("text"))
    body = F.concat_ws(" & ", *[F.coalesce(F.col(f"`{c}`"), F.lit("--")) for c in columns])
    rows_in = F.count(F.lit(1)).alias("_rows")
    blocks = cells.select("block", "place").distinct().groupBy("block").agg(rows_in, F.min("place").alias("_first"))
    last = cells.agg(F.max("block").alias("_last"))  # one row
    rows = wide.join(blocks, "block").join(F.broadcast(last))
    first = F.col("place") == F.col("_first")
    lead = F.when(first, F.concat(F.lit(r"\multirow{"), F.col("_rows").cast("string"), F.lit("}{*}{"), F.col("block").cast("string"), F.lit("}"))).otherwise("") if named_rows else F.col("block").cast("string")
    line = F.concat(F.lit("    "), F.concat_ws(" & ", lead, *([F.col("name")] if named_rows else []), body), F.lit(ROW_END))
    body_lines = rows.select(F.col("block").alias("_b"), F.col("place").alias("_p"), line.alias("line"))
    gaps = rows.filter(F.col("block") < F.col("_last")).groupBy(F.col("block").alias("_b")).agg(F.lit(1 << 30).alias("_p")).select("_b", "_p", F.lit(r"    \addlinespace[2ex]").alias("line"))
    head = [
        r"\begin{table}[tb]", r"  \centering", r"  \small", rf"  \begin{{tabular*}}{{\linewidth}}{{@{{\extracolsep{{\fill}}}} {'ll' if named_rows else 'l'} *{{{len(columns)}}}{{c}} @{{}}}}", r"    \toprule",
        rf"    \multicolumn{{{len(columns) + 1 + named_rows}}}{{c}}{{\textbf{{{title}}}}}{ROW_END}", r"    \addlinespace[2ex]", f"    $n$ & {'& ' * named_rows}{' & '.join(columns)}{ROW_END}", r"    \midrule",
    ]
    foot = [r"    \bottomrule", r"  \end{tabular*}", rf"  \caption{{{caption}}}", rf"  \label{{{label}}}", r"\end{table}"]
    spark = cells.sparkSession
    ends = spark.createDataFrame([(-(1 << 30), i, x) for i, x in enumerate(head)] + [(1 << 30, i, x) for i, x in enumerate(foot)], "_b long, _p long, line string")
    every = body_lines.unionByName(gaps).select(F.col("_b").cast("long").alias("_b"), F.col("_p").cast("long").alias("_p"), "line").unionByName(ends)
    # a table's lines are few
    return every.agg(F.array_sort(F.collect_list(F.struct("_b", "_p", "line"))).alias("l")).select(F.posexplode("l").alias("line_no", "x")).select("line_no", "x.line")


STARS = r"Stars tell significance: *$p<0.05$, **$p<0.01$, ***$p<0.001$."


def coefficient_table(regression: DataFrame, model: str, languages: list[str]) -> DataFrame:
    """``regression``: language, n, pos, beta, p_value. The mean of the first position and the differences of the others."""
    name = F.when(F.col("pos") == 0, "intercept").otherwise(F.concat(F.lit("position "), (F.col("pos") + 1).cast("string")))
    cells = regression.select(F.col("n").alias("block"), F.col("pos").alias("place"), name.alias("name"), F.col("language").alias("column"), two_places(F.col("beta"), F.col("p_value")).alias("text"))
    return grid(cells, languages, f"Coefficients of positions, {model}", f"Regression coefficients. {STARS}", f"tab:ols-coef-{_label(model)}")


def gini_table(gini: DataFrame, model: str, languages: list[str]) -> DataFrame:
    """``gini``: language, n, gini, p_value."""
    cells = gini.select(F.col("n").alias("block"), F.lit(0).alias("place"), F.lit("").alias("name"), F.col("language").alias("column"), two_places(F.col("gini"), F.col("p_value")).alias("text"))
    return grid(cells, languages, f"Gini indices, {model}", f"Gini indices, from 0 to 1. {STARS}", f"tab:gini-{_label(model)}", named_rows=False)


def anova_table(anova: DataFrame, model: str, languages: list[str]) -> DataFrame:
    """``anova``: language, n, p_value, eta_sq. Small p-values are told as such."""
    p = F.when(F.col("p_value") < 0.001, "<0.001").otherwise(F.format_string("%.3f", F.col("p_value")))
    both = F.array(F.struct(F.lit(0).alias("place"), F.lit("$p$").alias("name"), p.alias("text")), F.struct(F.lit(1).alias("place"), F.lit(r"$\eta^2_G$").alias("name"), F.format_string("%.3f", F.col("eta_sq")).alias("text")))
    cells = anova.select(F.col("n").alias("block"), F.col("language").alias("column"), F.inline(both))
    return grid(cells, languages, f"Analysis of variance, {model}", "Effect of the position.", f"tab:anova-{_label(model)}")


def difference_table(differences: DataFrame, model: str, languages: list[str]) -> DataFrame:
    """``differences``: language, n, pair, rel_diff, p_value: relative differences of positions in percent."""
    order = F.when(F.col("pair") == "1_vs_2", 0).when(F.col("pair") == "1_vs_last", 1).otherwise(2)
    cells = differences.select(F.col("n").alias("block"), order.alias("place"), F.replace("pair", F.lit("_"), F.lit(" ")).alias("name"), F.col("language").alias("column"), F.concat(F.format_string("%.1f", F.col("rel_diff")), F.coalesce(stars(F.col("p_value")), F.lit(""))).alias("text"))
    return grid(cells, languages, f"Differences of positions, {model}", rf"Relative differences in \%. {STARS}", f"tab:differences-{_label(model)}")


def sample_table(texts: DataFrame, languages: dict[str, str], length: int, label: str = "tab:sample") -> DataFrame:
    """``texts``: lang, text, a text of each language; the first ``length`` characters of each, by the languages' names in their order."""
    order = texts.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(languages.items())], "_i int, lang string, _name string")
    snippet = latex_escape(F.substring("text", 1, length))
    rows = texts.join(F.broadcast(order), "lang").select(F.col("_i").alias("_b"), F.concat(F.lit(r"    \textbf{"), "_name", F.lit("} & {"), snippet, F.lit("}" + ROW_END)).alias("line"))
    head = [r"\begin{table}[tb]", r"  \centering", r"  \small", r"  \begin{tabularx}{\linewidth}{@{}l X@{}}", r"    \toprule"]
    foot = [r"    \bottomrule", r"  \end{tabularx}", rf"  \label{{{label}}}", r"\end{table}"]
    ends = texts.sparkSession.createDataFrame([(i - len(head), x) for i, x in enumerate(head)] + [(len(languages) + i, x) for i, x in enumerate(foot)], "_b int, line string")
    return rows.unionByName(ends).agg(F.array_sort(F.collect_list(F.struct("_b", "line"))).alias("l")).select(F.posexplode("l").alias("line_no", "x")).select("line_no", "x.line")
