"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, forest, ftrl, heaps, jaccard, languages, neighbours, packing, pieces, quality, ranked, repair, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return repair.documents(spark, path, with_ids=False)


def op2_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


def op7_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_mixtures(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))


def op8_count_vector_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "copy_of")


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_block_max_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.get("evidence", F.lit(0))["doc_id"].alias("nearest"))


def op11_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op12_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heaps.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, salt="3:")


QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_token_file,
        op2_difference_cover_dedup,
        op3_longest_match_counts,
        op4_robust_outlier_rules,
        op5_ftrl_quality,
        op6_sum_of_squares_packing,
        op7_language_mixtures,
        op8_count_vector_rtree_join,
        op9_minhash_containment,
        op10_block_max_neighbours,
        op11_hash_prefix_forest,
        op12_limited_accumulators,
        op13_heap_bounds,
    )
}
#: Words w of each document, and (folded) of each document or item.
_WORDS = "select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents"
_FOLDED = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)"



def _clusters(k: int, rounds: int, dims: int, salt: str) -> str:
    """Rounds of assignment and floored means, one table each."""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    assigned = f"select vec_id, v, arg_min(j, {{'d': {far}, 'j': j}}) j, min({far}) d from x, cROUND group by vec_id, v"
    steps = [
        f"""x as materialized (select vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) v from embeddings
            where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims})""",
        f"c0 as materialized (select (row_number() over (order by h) - 1)::int j, v c from (select v, sha256('{salt}' || vec_id) h from x order by h limit {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} as materialized ({assigned.replace("ROUND", str(r))})",
            f"s{r} as (select j, i, sum(e)::hugeint s, count(*) n from (select j, unnest(v) e, unnest(range(1, {dims} + 1)) i from a{r}) group by j, i)",
            f"m{r} as (select j, list(((s - ((s % n) + n) % n) // n)::bigint order by i) c from s{r} group by j)",
            f"c{r + 1} as materialized (select j, coalesce(m{r}.c, c{r}.c) c from c{r} left join m{r} using (j))",
        ]
    return f"""
        with {", ".join(steps)},
        last as materialized ({assigned.replace("ROUND", str(rounds))})
        select vec_id, j "cluster", d distance, (sum(d) over (partition by j))::bigint cluster_inertia, (sum(d) over ())::bigint inertia,
            sha256(array_to_string(c, ',')) centroid_sha256 from last join c{rounds} using (j)"""


#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_difference_cover_dedup": f"""
        with d as ({_WORDS}),
        win as (select doc_id, unnest(range(1, len(w) - 18)) s, w from d where len(w) >= 20),
        seq as (select doc_id, s, array_to_string(w[s : s + 19], ' ') t from win),
        late as (select doc_id, s from (select doc_id, s, row_number() over (partition by t order by doc_id, s) r from seq) where r > 1),
        gone as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) p from late)),
        cut as (select doc_id, list(p) gone from gone group by 1),
        kept as (select d.doc_id, len(w) n, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains(coalesce(gone, []), i) then null else w[i] end), lambda x: x is not null) k from d left join cut using (doc_id))
        select doc_id, n::bigint n_words, (n - len(k))::bigint n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from kept""",
    "op8_count_vector_rtree_join": f"""
        with recursive d as (select doc_id, {_SHINGLES} s from (select doc_id, {_FOLDED} w from documents)),
        reps as (select min(doc_id) rep, list_sort(s) ss, len(any_value(s)) n from d where len(s) > 0 group by list_sort(s)),
        own as (select rep, n, unnest(ss) x from reps),
        pairs as (select a.rep a, b.rep b from own a join own b on a.x = b.x and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        edges as (select a u, b v from pairs union all select b, a from pairs),
        reach(node, other) as (select rep, rep from reps union select node, v from reach join edges on other = u),
        comp as (select node, min(other) c from reach group by 1)
        select doc_id, len(s)::bigint n_shingles, coalesce(c, doc_id)::bigint component_id, coalesce(rep, doc_id)::bigint copy_of
        from d left join reps on list_sort(s) = ss left join comp on node = rep""",
    "op9_minhash_containment": f"""
        with i as (select item_id, {_SHINGLES} s from (select item_id, {_FOLDED} w from benchmark)),
        d as (select doc_id, {_SHINGLES} s from (select doc_id, {_FOLDED} w from documents)),
        ix as (select item_id, len(s) n, unnest(s) x from i),
        dx as (select doc_id, unnest(s) x from d)
        select doc_id, item_id, n::bigint n_item_shingles, count(*)::bigint n_shared from ix join dx using (x)
        group by doc_id, item_id, n having 100 * count(*) >= 80 * n""",
    "op12_limited_accumulators": r"""
        with folded as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from documents),
        tf as (select doc_id, t, count(*) f from folded group by all),
        lengths as (select doc_id, sum(f)::bigint n from tf group by 1),
        whole as (select count(*) big_n, sum(n)::bigint l from lengths),
        asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
        w as (select t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::bigint w from tf, whole group by t, big_n),
        scores as (select item_id, doc_id, sum(w * ((1000000000 * f) // (1000 * f + 8 * (100 - 90 + ((90 * n * big_n) // l)))))::bigint score from asked join tf using (t) join w using (t) join lengths using (doc_id), whole group by 1, 2)
        select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int "rank", doc_id, score from scores where score > 0
        qualify "rank" <= 10""",
    "op13_heap_bounds": _clusters(8, 10, 64, "3:"),
}
