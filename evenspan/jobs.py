"""The jobs behind the command line, each a function of a session and a settings dictionary.

``tokenize`` → ``create_indices`` → ``compute_embeddings`` → the analyses; ``analyze_attention`` and
``clean_titles`` stand beside them. A job returns the frame it wrote, read again, if the settings name an
output path, else the frame itself.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import titles as N
from .functions import vectors as V
from .operators import assemble as B
from .operators import attention as A
from .operators import calibrated as K
from .operators import corpus as C
from .operators import design as D
from .operators import encode as E
from .operators import similarity as M
from .operators import stats as T
from .operators import subwords as W
from .sources import files as S
from .sources.scratch import saved

READERS: dict[str, Callable[..., DataFrame]] = {"csv": S.csv_documents, "jsonl": S.json_lines}


def _written(df: DataFrame, path: str | None, *by: str) -> DataFrame:
    if path is None:
        return df
    S.write_partitioned(df, path, *by)
    return df.sparkSession.read.parquet(path)


def tokenize(spark: SparkSession, cfg: dict, tokenizer: Callable | None = None) -> DataFrame:
    """id, lang, text, input_ids, length of a data set of the given format (parquet, csv, jsonl or txt).

    A tokenizer is given, or made of the settings: vocabulary_path (a file of pieces, cut by longest match), with begin_token
    and end_token among its pieces and max_length. Without either each whitespace word stands for its length, between a
    begin token 101 and an end token 102; a null text has neither ids nor length.
    """
    kind, path = cfg.get("dataset_format", "parquet"), cfg["dataset_path"]
    ident, text = cfg.get("id_column", "id"), cfg.get("text_column", "text")
    if kind == "txt":
        docs = S.text_directory(spark, path)
    elif kind in READERS:
        docs = READERS[kind](spark, path, ident, text)
        docs = docs.filter("ok").drop("ok") if "ok" in docs.columns else docs
    else:
        docs = spark.read.parquet(path).withColumnsRenamed({ident: "id", text: "text"})
    docs = docs.withColumn("id", F.col("id").cast("string"))
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(cfg.get("language", "en")))
    docs = docs.select("id", "lang", "text")
    if tokenizer is None and (at := cfg.get("vocabulary_path")):
        pieces = W.vocabulary_file(spark, at, cfg.get("unknown_token", W.UNKNOWN))
        ends = [pieces.index(cfg[k]) if cfg.get(k) else None for k in ("begin_token", "end_token")]
        tokenizer = W.tokenizer(pieces, *ends, cfg.get("max_length"), unknown=cfg.get("unknown_token", W.UNKNOWN))
    if tokenizer is not None:
        return _written(E.tokenize_with(docs, tokenizer, most=cfg.get("max_length")), cfg.get("output_path"), "lang")
    ids = F.concat(F.array(F.lit(101)), F.transform(B.whitespace_pieces(F.col("text")), lambda w: F.length(w)), F.array(F.lit(102)))
    out = docs.withColumn("input_ids", ids)
    return _written(out.withColumn("length", F.size("input_ids")), cfg.get("output_path"), "lang")


def create_indices(spark: SparkSession, cfg: dict, meta: DataFrame) -> DataFrame:
    """doc_no, perm, segs: the documents of an experiment over aligned segments (dataset_idx, lang, token_length).

    Segments are those whose source length is in range and whose targets are within tolerance; sets are drawn,
    and each gives all its orders, so that the sample size is rounded up to a multiple of k!.
    """
    k = cfg["concat_size"]
    source = meta.filter(F.col("lang") == cfg["source_lang"])
    pool = D.length_range(source, *cfg["source_segment_range"])
    targets = dict(zip(cfg.get("target_langs", []), cfg.get("source_target_segment_diffs", []), strict=True))
    if targets:
        pool = pool.join(D.parallel_lengths(meta, cfg["source_lang"], targets), "dataset_idx", "left_semi")
    n = D.rounded_sample(cfg["sample_size"], k)
    orders = D.factorial(k)
    sets = D.sampled_sets(pool.select(F.col("dataset_idx").alias("seg_id"), "token_length"), k, n // orders, cfg.get("max_total_length"), cfg.get("seed", 0))
    out = D.permuted(sets, k).select((F.col("set_no") * orders + F.col("perm")).alias("doc_no"), "set_no", "perm", "segs")
    return _written(out, cfg.get("output_path"))


def resolve_indices(spark: SparkSession, cfg: dict, meta: DataFrame | None = None) -> DataFrame:
    """doc_no and segs from, in this order: a file of indices, the settings of another run, or a draw of its own."""
    if path := cfg.get("indices_path"):
        return S.indices(spark, path)[0]
    if reference := cfg.get("reference_config"):
        return resolve_indices(spark, reference, meta)
    return create_indices(spark, cfg, meta).select("doc_no", "segs")


def embedder_settings(cfg: dict, embedder: str) -> dict:
    """What holds for one embedder, "standalone" or "latechunk": its own key (``latechunk_calib_layers``) goes before the
    common one (``calib_layers``); pooling and the tokens that stand apart follow ``encode.overrides``."""
    pick = lambda key, default=None: cfg.get(f"{embedder}_{key}", cfg.get(key, default))
    how = E.overrides(
        pick("pooling"), pick("padding_side"), pick("calib_source_tokens"), pick("isolate_bos"), pick("isolate_eos"),
        model_pooling=pick("model_pooling"), decoder=bool(pick("decoder", False)),
    )
    return how | {"calibrate": bool(pick("apply_attn_calibration", False)), "layers": pick("calib_layers"), "size": pick("calib_basket_size", 128), "strength": pick("calib_strength", 1.0)}


def calibration_of(settings: dict, n_layers: int) -> K.Calibration | None:
    """The calibration that an embedder's settings ask for; layers are a number, "last" or "last_half"."""
    if not settings["calibrate"]:
        return None
    layers = settings["layers"]
    if layers is None:
        raise ValueError("calib_layers must be given where attention is calibrated")
    if isinstance(layers, str):
        layers = len(A.calibrated_layers(n_layers, layers))
    rows = {"cls": "cls", "all": "all", "last": "last"}[settings["calibrated_tokens"]]
    return K.Calibration(settings["size"], layers, settings["strength"], rows, settings["isolate_first"], settings["isolate_last"])


def compute_embeddings(spark: SparkSession, cfg: dict, tokenized: DataFrame, indices: DataFrame, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(standalone, document, late) embeddings of documents over aligned segments (dataset_idx, lang, text, input_ids).

    Position 0 is in the target language, if there is one, all others in the source language. ``encoder`` makes a function
    from ids to vectors (``encode.encode_with``) or an encoder by layers (``operators.calibrated``), which settings that
    calibrate attention need.
    """
    encoder = encoder or E.fixture_encoder()
    source, target = cfg["source_lang"], cfg.get("target_lang")
    seg = tokenized.select(F.concat(F.col("dataset_idx").cast("string"), "lang").alias("seg_id"), "text", "input_ids")
    docs = indices.select(F.col("doc_no").alias("doc_id"), D.mixed_language_ids(F.col("segs"), source, target).alias("segs"))
    layers = getattr(encoder(), "n_layers", None)  # None: a plain function

    def hidden(rows: DataFrame, how: dict) -> DataFrame:
        if layers is not None:
            return K.encode_layers(rows, encoder, calibration_of(how, layers), left=how["padding_side"] == "left")
        if how["calibrate"]:
            raise ValueError("calibrated attention needs an encoder by layers")
        return E.encode_with(rows, encoder)

    own, late_how = embedder_settings({"model_pooling": "mean"} | cfg, "standalone"), embedder_settings({"model_pooling": "mean"} | cfg, "latechunk")
    used = seg.join(D.used_segments(docs), "seg_id", "left_semi")
    alone = hidden(used, own).select("seg_id", E.pooled(F.col("hidden"), own["pooling"]).alias("embedding"))
    parts = B.gathered(docs, seg).filter(~F.col("missing"))
    whole = hidden(B.assembled(parts, cfg.get("separator_ids"), 101, 102), late_how)
    document = whole.select("doc_id", E.pooled(F.col("hidden"), late_how["pooling"]).alias("embedding"))
    spans = F.transform(F.arrays_zip("doc_ids", "doc_boundaries"), lambda x: F.struct(x["doc_ids"].alias("seg_id"), F.get(x["doc_boundaries"], F.lit(0)).alias("start"), F.get(x["doc_boundaries"], F.lit(1)).alias("end")))
    late = E.segment_vectors(whole.withColumn("segments", spans))
    out = cfg.get("embeddings_output_dir")
    kinds = (("standalone", alone), ("document", document), ("late", late))
    return tuple(_written(f, f"{out}/kind={kind}" if out else None) for kind, f in kinds)


def analyze_attention(spark: SparkSession, cfg: dict, attention: DataFrame) -> dict[str, DataFrame]:
    """Baskets, maps and bin masses of long-form attention by the settings basket_size, rel_bins, only_first_row."""
    size, bins = cfg.get("basket_size", 128), cfg.get("rel_bins", 20)
    inc = A.incoming(attention, cfg.get("only_first_row", False))
    trim = A.trimmed(inc, cfg.get("exclude_first", True), cfg.get("exclude_last", True))
    return {
        "ends": A.ends(inc), "baskets_absolute": A.absolute_baskets(trim, size), "baskets_relative": A.relative_baskets(trim, bins),
        "map_absolute": A.absolute_map(attention, size), "map_relative": A.relative_map(attention, bins), "bin_mass": A.bin_mass(attention, size),
    }


def clean_titles(lines: DataFrame) -> DataFrame:
    """src, tgt of title lines: parsed, cleaned, article pages only, unambiguous."""
    pairs = S.title_pairs(lines)
    cleaned = pairs.select("line_no", *[N.strip_title(N.normalize_title(F.col(c))).alias(c) for c in ("src", "tgt")])
    return C.unambiguous(C.articles_only(cleaned))


def vector_norms(frame: DataFrame) -> DataFrame:
    """Least and greatest length of a frame's embeddings, which a normalised store has at 1."""
    return frame.agg(F.min(V.norm(F.col("embedding"))).alias("lo"), F.max(V.norm(F.col("embedding"))).alias("hi"))


#: The parts of the results, by what they are made of.
OF_SIMS, OF_LEAKAGE = ("profile", "differences", "welch", "wilcoxon", "anova", "regression", "gini"), ("leakage", "leakage_test", "positional_leakage")


def quantitative_results(runs: DataFrame, sims: DataFrame, model: str, languages: list[str], leakage: DataFrame | None = None, permutations: int = 10_000, parts: list[str] | None = None) -> dict[str, DataFrame]:
    """Every position statistic of every run of a model, or the ``parts`` named, each with the run's name in the column run: the runs
    (name) are categorised and chosen, and all go through one plan for each statistic. ``sims``: run, (kind,) doc_id, item, pos, sim,
    where kind tells the similarities of whole documents from those of late segments; ``leakage``: run, src, dst, sim of
    ``similarity.leakage_pairs``. Similarities are made once for all parts, and so are means and pairs where several parts read them."""
    parts = [*OF_SIMS, *(OF_LEAKAGE if leakage is not None else ())] if parts is None else parts
    chosen = S.run_catalog(runs, model, languages).select(F.col("name").alias("run")).distinct()
    by = [c for c in ("run", "kind") if c in sims.columns]
    once = lambda df, name, readers: saved(df, name) if len(set(readers) & set(parts)) > 1 else df
    makers = {}
    if set(parts) & set(OF_SIMS):
        sims = saved(sims.join(chosen, "run", "left_semi").select(*by, "doc_id", "item", "pos", "sim"), "sims")
        pairs = once(T.position_pairs(sims, by=by), "pairs", ("differences", "welch", "wilcoxon"))
        means = saved(T.item_means(sims, by=by), "means") if {"anova", "gini"} & set(parts) else None
        makers = {
            "profile": lambda: M.profile(sims, [*by, "pos"]), "differences": lambda: T.position_differences(pairs, by), "welch": lambda: T.welch(pairs, by), "wilcoxon": lambda: T.wilcoxon(pairs, by=by),
            "anova": lambda: T.rm_anova(means, by), "regression": lambda: T.clustered_ols(sims, by=by), "gini": lambda: T.gini(means, by).join(T.gini_test(means, permutations, by=by).drop("gini"), by),
        }
    if leakage is not None and set(parts) & set(OF_LEAKAGE):
        leakage = once(leakage.join(chosen, "run", "left_semi").select("run", "src", "dst", "sim"), "leakage", OF_LEAKAGE)
        makers |= {"leakage": lambda: M.directional_leakage(leakage, ["run"]), "leakage_test": lambda: M.leakage_test(leakage, ["run"]), "positional_leakage": lambda: M.positional_leakage(leakage, ["run"])}
    return {part: makers[part]() for part in parts}
