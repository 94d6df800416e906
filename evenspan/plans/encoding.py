"""Queries of calibrated encoding (C3 with the encoder hook U6) and of subword tokens (F5, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as B
from ..operators import calibrated as K
from ..operators import encode as E
from ..operators import subwords as W
from ..registry import query
from . import fixtures as X

#: Baskets of the example; its encoder has two layers, of which the last is calibrated.
SIZE = 32
HOW = K.Calibration(size=SIZE, layers=1)
ENCODER = K.layered_fixture(dim=4, heads=2, layers=2, sharp=4.0)


def conversations(spark, d):
    """doc_id, input_ids: the turns of a conversation in order, each word as its length, between begin and end tokens."""
    c = X.table(spark, d, "conversations").withColumn("ids", F.transform(B.whitespace_pieces(F.col("text")), lambda w: F.length(w)))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "ids"))), lambda x: x["ids"])  # the turns of one conversation
    whole = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.flatten(turns).alias("ids"))
    return whole.select("doc_id", F.concat(F.array(F.lit(101)), "ids", F.array(F.lit(102))).alias("input_ids"))


#: The same transformer in SQL: x1, vectors after the first layer; w1, the row of the first token in the second; cal, that row evened out.
ENCODED_SQL = rf"""
ci as (select conv_id doc_id, list_concat([101], flatten(list(list_transform(string_split_regex(trim(text), '\s+'), lambda w: length(w)) order by turn)), [102]) ids from conversations group by conv_id),
ti as (select doc_id, len(ids) n, unnest(ids) id, generate_subscripts(ids, 1) - 1 i from ci),
x0 as (select doc_id, n, i, cos(id) / sqrt(1 + i) a, cos(2 * id) / sqrt(1 + i) b, cos(3 * id) / sqrt(1 + i) c, cos(4 * id) / sqrt(1 + i) d from ti),
e0 as (select q.doc_id, q.i, exp(4 * (q.a * k.a + q.b * k.b)) e, exp(4 * (q.c * k.c + q.d * k.d)) f, k.a, k.b, k.c, k.d from x0 q join x0 k on q.doc_id = k.doc_id),
y0 as (select doc_id, i, sum(e * a) / sum(e) a, sum(e * b) / sum(e) b, sum(f * c) / sum(f) c, sum(f * d) / sum(f) d from e0 group by all),
x1 as (select doc_id, n, i, [(x0.a + y0.a) / 2, (x0.b + y0.b) / 2, (x0.c + y0.c) / 2, (x0.d + y0.d) / 2] v from x0 join y0 using (doc_id, i)),
l1 as (select k.doc_id, k.n, h, k.i k, k.v, exp(4 * (q.v[2 * h + 1] * k.v[2 * h + 1] + q.v[2 * h + 2] * k.v[2 * h + 2])) e from x1 q join x1 k on q.doc_id = k.doc_id, range(2) r(h) where q.i = 0),
w1 as (select doc_id, n, h, k, v, e / sum(e) over (partition by doc_id, h) w from l1),
b1 as (select *, sum(case when k = 0 then w else 0 end) over (partition by doc_id, h) first, w / sum(w) over (partition by doc_id, h, case when k = 0 then -1 else (k - 1) // {SIZE} end) part from w1),
c1 as (select *, case when k = 0 then w else (1 - first) * part / ceil((n - 1) / {SIZE}::double) end c from b1),
cal as (select doc_id, n, h, k, v, w, case when n - 1 >= {SIZE} then 0.5::double * c / sum(c) over (partition by doc_id, h) + 0.5::double * w else w end w_cal from c1)"""


@query("c03_calibrated_encoding", f"""with {ENCODED_SQL},
 y1 as (select doc_id, n, j, sum(w_cal * v[j]) y from cal, range(1, 5) r(j) where h = (j - 1) // 2 group by all),
 z as (select y1.doc_id, y1.n, j, (x1.v[j] + y) / 2 z from y1 join x1 on x1.doc_id = y1.doc_id and x1.i = 0)
 select doc_id, n - 1 >= {SIZE} calibrated, (j - 1)::int dim, round(z / sqrt(sum(z * z) over (partition by doc_id)), 6) x from z""")
def c03_calibrated(spark, d):
    e = K.encode_calibrated(conversations(spark, d), ENCODER, HOW)
    return e.select("doc_id", "calibrated", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("c03_calibrated_attention", f"with {ENCODED_SQL} select doc_id, h::int head, k::int k, round(w, 6) w, round(w_cal, 6) w_cal from cal")
def c03_attention(spark, d):
    r = K.attention_rows(conversations(spark, d), ENCODER, HOW, layers=[1], first_row_only=True)
    return r.select("doc_id", "head", "k", F.round("w", 6).alias("w"), F.round("w_cal", 6).alias("w_cal"))


# ---- subword tokens: the vocabulary is a stated one, of the words of another table ----


def pieces(spark, d):
    """piece: the words of ``benchmark`` and their first one to four letters begin a word; its single letters and last two to four go on one."""
    w = X.table(spark, d, "benchmark").select(F.explode(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''").distinct()
    first = [F.substring("w", 1, n) for n in (1, 2, 3, 4)]
    on = [F.concat(F.lit("##"), F.right("w", F.lit(n))) for n in (2, 3, 4)]
    letters = F.transform(F.split("w", ""), lambda c: F.concat(F.lit("##"), c))
    return w.select(F.explode(F.concat(F.array("w", *first, *on), letters)).alias("piece")).distinct()


#: vb: pieces with their numbers; dw: words of documents; cut: of each different word its pieces' numbers in order, or the unknown's 0.
SUBWORD_SQL = r"""
bw as (select distinct unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) w from benchmark),
vp as (select w piece from bw union select w[: n] from bw, range(1, 5) r(n) union select '##' || right(w, n) from bw, range(2, 5) r(n) union select '##' || unnest(string_split(w, '')) from bw),
vb as (select piece, row_number() over (order by piece) id from vp where piece <> '[UNK]'),
dw as (select doc_id, unnest(words) word, generate_subscripts(words, 1) place from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words from documents)),
uw as (select distinct word from dw),
ch as (select word, unnest(range(1, least(length(word), 100) + 1)) a from uw where length(word) <= 100),
cand as (select word, a, unnest(range(1, least(length(word) - a + 1, (select max(length(piece)) from vb)) + 1)) n from ch),
fits as (select word, a, max_by(id, n) id, max(n) n from cand join vb on vb.piece = (case when a = 1 then '' else '##' end) || word[a : a + n - 1]
  where a > 1 or word[: 2] <> '##' or n < 2 group by word, a),
walk as (select word, a, id, a + n nxt from fits where a = 1 union all select f.word, f.a, f.id, f.a + f.n from walk w join fits f on f.word = w.word and f.a = w.nxt),
done as (select word, list(id order by a) ids from walk group by word having max(nxt) = length(word) + 1),
cut as (select uw.word, coalesce(ids, [0]) ids from uw left join done on done.word = uw.word)"""


def _subwords(spark, d):
    return W.subword_tokens(X.table(spark, d, "documents").select("doc_id", "text"), W.vocabulary(pieces(spark, d)))


@query("f05_subword_tokens", f"""with recursive {SUBWORD_SQL}
 select doc_id, sum(len(ids))::int n_tokens, count(*) filter (ids = [0])::int n_unknown, md5(string_agg(array_to_string(ids, ' '), ' ' order by place)) ids_md5 from dw join cut on cut.word = dw.word group by doc_id""")
def f05_subwords(spark, d):
    ids = F.col("tokens.id")
    return _subwords(spark, d).select(
        "doc_id", F.size(ids).alias("n_tokens"), F.size(F.filter(ids, lambda i: i == 0)).alias("n_unknown"), F.md5(F.array_join(ids.cast("array<string>"), " ")).alias("ids_md5")
    ).filter("n_tokens > 0")


@query("u01_subword_hook", f"""with recursive {SUBWORD_SQL}, al as (select doc_id, list_slice(flatten(list(ids order by place)), 1, 126) ids from dw join cut on cut.word = dw.word group by doc_id)
 select doc_id, (len(ids) + 2)::int length, list_sum(ids)::bigint + 2 * (select count(*) from vb) + 3 total from al""")
def u01_subwords(spark, d):
    vocab = W.vocabulary(pieces(spark, d))
    docs = X.table(spark, d, "documents").select("doc_id", "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = E.tokenize_with(docs, W.tokenizer(vocab, len(vocab), len(vocab) + 1, 128))
    return out.select("doc_id", "length", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
