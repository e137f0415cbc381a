"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, lattice, licenses, mixing, neighbours, quality, recompression, runs, sharding, simhash, suffix_levels, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, counts at most one apart."""
    docs = _read(spark, sf_dir, "documents")
    utf8 = F.encode("text", "UTF-8")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    out = sharding.shard(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all documents."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("same"))
    out = mixing.mix(rows, identity=F.xxhash64("doc_id", "source", "same"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of all documents."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades_of(_read(spark, sf_dir, "labels")))
    p = F.col("p_grade")
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "expected_grade", p[0].alias("p_at_least_1"), p[1].alias("p_at_least_2"), (p[0] >= quality.THRESHOLD).alias("keep")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents left after windows of 50 that a smaller doc_id has too."""
    out = recompression.removed(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents left after 200-byte strings that occur elsewhere too."""
    out = suffix_levels.removed(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in all documents."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct("matches.template")), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best_containment"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits in all documents."""
    found = decontamination.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return lattice.link(_read(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all embeddings after three rounds."""
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose vec_id is divisible by 20."""
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, some of which get a periodic end first."""
    found = runs.collapsed(runs.planted(_read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n", "")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = found.withColumn("best", runs.best_run(F.col("runs")))
    exponent = F.expr("1000L * best.length div best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash_dedup, op3_source_mixing, op4_quality_classifier, op5_toxicity, op6_recompression_dedup, op7_suffix_dedup, op8_decontamination, op9_license_scan, op10_lattice_dedup, op11_centroid_clustering, op12_nearest_neighbours, op13_run_detection, pipeline)}

#: Words of a benchmark item or a document, A-Z lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP8 = rf"""
with d as (select row_number() over () r, doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark where item_id is not null),
bw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') s
       from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) where len(w) > 0),
dw as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') s from d, (select distinct n from bw) z, unnest(range(1, len(w) - n + 2)) t(i) where len(w) >= n),
hits as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.s = bw.s),
pos as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from (select distinct r, i, n from hits)) group by r),
its as (select r, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hits group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (r) left join its using (r)
"""

_OP6 = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
x as (select r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) h from d, unnest(range(1, len(w) - 48)) t(i)),
f as (select h, min(doc_id) least from x group by h),
m as (select distinct r, unnest(range(i, i + 50)) p from x join f using (h) where least < doc_id),
g as (select r, list(p order by p) ps from m group by r),
k as (select doc_id, len(w) n, coalesce(len(ps), 0) c, d.r, w, ps from d left join g using (r)),
u as (select r, string_agg(w[i], ' ' order by i) kept from (select d.r, w, unnest(range(1, len(w) + 1)) i from d) z where not exists (select 1 from m where m.r = z.r and m.p = z.i) group by r)
select doc_id, cast(n as bigint) n_words, cast(c as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from k left join u using (r)
"""

_OP7 = """
with n as (select r, doc_id, h, length(h) // 2 n from (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents)),
w as (select r, i, md5(substr(h, 2 * i + 1, 400)) m from n, unnest(range(0, n - 199)) t(i)),
s as (select r, i from w semi join (select m from w group by m having count(*) > 1) f using (m)),
g as (select r, i, sum(fresh) over (partition by r order by i) k from (select r, i, case when i > lag(i) over (partition by r order by i) + 200 then 1 else 0 end fresh from s)),
sp as (select r, k, min(i) a, max(i) + 200 b from g group by r, k),
e as (select r, a, b, lead(a) over (partition by r order by a) z from sp),
p as (select r, 0 o, substr(h, 1, 2 * a) p from n join (select r, min(a) a from sp group by r) using (r) union all select r, b, substr(h, 2 * b + 1, 2 * (coalesce(z, n) - b)) from e join n using (r)),
k as (select r, string_agg(p, '' order by o) kept from p group by r),
c as (select r, sum(b - a) gone, count(*) spans from sp group by r)
select doc_id, cast(n as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from n left join k using (r) left join c using (r)
"""

_OP10 = """
with recursive v as (
  select row_number() over () r, vec_id, label, [cast(x as double) for x in embedding] e,
    label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 good
  from embeddings),
p as (select a.r ra, b.r rb, a.vec_id va, b.vec_id vb from v a join v b on a.label = b.label and a.r <> b.r and a.good and b.good and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(r, m) as (select r, vec_id from v where good union select p.ra, reach.m from reach join p on p.rb = reach.r),
c as (select r, min(m) m from reach group by r),
n as (select ra r, count(*) n from p group by ra)
select vec_id, coalesce(n.n, 0) n_links, coalesce(c.m, vec_id) component_id, vec_id is not distinct from coalesce(c.m, vec_id) kept
from v left join c using (r) left join n using (r)
"""



def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Every round written out: assignment to the least (distance, number), then exact floors of means."""
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = ""
    for t in range(rounds + 1):
        steps += f", a{t} as (select r, arg_min(k, (d, k)) k, min(d) d from (select v.r, c.k, cast({distance} as bigint) d from v, c{t} c) group by r)"
        if t < rounds:
            floors = "select k, j, (s - ((s % n) + n) % n) // n x from (select a.k, j, cast(sum(v.e[j]) as bigint) s, count(*) n from v join a{0} a using (r), range(1, 65) z(j) group by a.k, j)".format(t)
            steps += f", c{t + 1} as (select c.k, coalesce(m.e, c.e) e from c{t} c left join (select k, list(x order by j) e from ({floors}) group by k) m using (k))"
    return f"""
with v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id), e) - 1 k, e from v qualify k < {k}){steps}
select vec_id, cast(k as integer) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(c.e, ',')) centroid_sha256
from a{rounds} join v using (r) join c{rounds} c using (k)
"""


_OP12 = """
with v as (select row_number() over () r, vec_id, [cast(x as double) for x in embedding] e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score, q.r from v q join v c on len(q.e) = len(c.e) and q.r <> c.r where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) "rank", vec_id, score from p qualify "rank" <= 20
"""

_OP13 = r"""
with tab as (select list(list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) t from range(256) z(k)),
d0 as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') w from documents),
d1 as (select r, doc_id, w, len(w) n, coalesce(xor(list_reduce(list_concat([4294967295], [cast('0x' || x as bigint) for x in regexp_extract_all(hex(encode(cast(doc_id as varchar))), '..')]),
         lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295), 1) h from d0, tab),
d2 as (select *, h // 10 g, case when n > 0 then (h // 10) % n end a from d1),
d as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else w end w from d2),
o as (select r, i, w[i + 1] x from d, unnest(range(0, n)) z(i)),
u as (select o.r, o.x, list(o.i order by o.i) places from o group by o.r, o.x having count(*) >= 4),
c as (select distinct r, q from (select u.r, i, j - i q from u, unnest(places) y(i), unnest(places) z(j) where j > i and list_contains(places, i + 2 * (j - i)) and list_contains(places, i + 3 * (j - i)))),
e as (select c.r, q, i from c join d using (r), unnest(range(0, n - q)) z(i) where w[i + 1] = w[i + q + 1]),
g as (select r, q, min(i) s, max(i) + 1 + q e from (select r, q, i, i - row_number() over (partition by r, q order by i) k from e) group by r, q, k),
f as (select r, q, s, e from g where e - s >= greatest(6, 4 * q)),
m as (select * from f where not exists (select 1 from f b where b.r = f.r and b.q < f.q and b.s <= f.s and b.e >= f.e)),
s as (select r, count(*) n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' order by s, q) runs from m group by r),
b as (select r, s "start", e - s length, q period, row_number() over (partition by r order by cast(e - s as double) / q desc, s, q) k from m),
x as (select distinct r, unnest(range(s + q, e)) i from m),
kept as (select o.r, string_agg(x, ' ' order by i) kept from o anti join x using (r, i) group by o.r)
select doc_id, coalesce(n_runs, 0) n_runs, cast("start" as bigint) "start", cast(length as bigint) length, cast(period as bigint) period, cast(1000 * length // period as bigint) exponent_milli,
  sha256(coalesce(runs, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
from d left join s using (r) left join (select * from b where k = 1) using (r) left join kept using (r)
"""

_ROUNDS = sharding.round_keys(20260101)


def _sharding_sql(shards: int = 40) -> str:
    """The permutation written out: six rounds nested, walked by a recursive table."""

    def mixed(v: str, key: int) -> str:
        f1 = f"(({v} + {key}) % {2**31} * 1103515245 % {2**31})"
        f2 = f"(xor({f1}, {f1} >> 15) * 1566083941 % {2**31})"
        return f"xor({f2}, {f2} >> 13)"

    def network(source: str) -> str:
        sql = f"select r, v // b l, v % b h, a, b, n from {source}"
        for i, key in enumerate(_ROUNDS):
            sql = f"select r, (l + {mixed('h', key)}) % a l, h, a, b, n from ({sql})" if i % 2 == 0 else f"select r, l, (h + {mixed('l', key)}) % b h, a, b, n from ({sql})"
        return f"select r, l * b + h v, a, b, n from ({sql})"

    return f"""
with recursive n as (select count(*) n from documents),
s as (select n, a, (n + a - 1) // a b from (select n, cast(ceil(sqrt(n)) as bigint) a from n)),
tab as (select list(list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by k) t from range(256) z(k)),
d as (select row_number() over (order by doc_id) - 1 r, doc_id, text, octet_length(encode(text)) size from documents),
e as (select r, doc_id, coalesce(size, 0) + 16 size, case when text is not null then xor(list_reduce(
        list_concat([4294967295], [cast('0x' || x as bigint) for x in regexp_extract_all(hex(encode(text)), '..')]),
        lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) end text_crc32 from d, tab),
walk as ({network('(select r, r v, a, b, n from d, s)')} union all ({network('(select * from walk where v >= n)')}))
select doc_id, size, text_crc32, 'rows' law, cast(v % {shards} as integer) shard, v // {shards} slot, cast(null as integer) grown_shard
from e join (select r, v from walk where v < n) using (r)
"""


SQL = {"op1_sharding": _sharding_sql(), "op6_recompression_dedup": _OP6, "op7_suffix_dedup": _OP7, "op8_decontamination": _OP8, "op10_lattice_dedup": _OP10, "op11_centroid_clustering": _clustering_sql(), "op12_nearest_neighbours": _OP12, "op13_run_detection": _OP13}
