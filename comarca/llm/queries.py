"""The dealt operators on the driver tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.alignment import aligned_tokens
from comarca.llm.anchors import without_repeated_passages
from comarca.llm.collocations import collocations
from comarca.llm.common import documents, stored, tokenizer_file
from comarca.llm.exact import exact_groups
from comarca.llm.hamming import nearest_codes, sign_code
from comarca.llm.huffman import encoded_ids
from comarca.llm.jaccard import similar_groups
from comarca.llm.language import identify
from comarca.llm.mixing import mix_sources
from comarca.llm.repeats import without_repeats
from comarca.llm.scoring import language_scores
from comarca.llm.sharding import shard_by_bytes
from comarca.llm.viterbi import sentencepiece_ids


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_ids(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 20, among all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = stored(rows.select("vec_id", sign_code(F.col("embedding")).alias("code")))
    return nearest_codes(rows, rows.filter("vec_id % 20 = 0"), k=10)


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sentencepiece_ids(docs, tokenizer_file("piece_bpe_32k.model"))


def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=50256)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="max")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_tokens(
        documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    )


def op12_remove_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_passages(documents(spark, sf_dir), window=35)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), min_count=100, longest=5, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_hamming_top_k": """
            with codes as (
              select vec_id, [case when x > 0 then 1.0 else 0.0 end for x in embedding] as bits
              from embeddings where embedding is not null
            ),
            pairs as (
              select q.vec_id as query_id, c.vec_id as neighbor_id,
                     cast(round(pow(list_distance(q.bits, c.bits), 2)) as bigint) as distance
              from codes q join codes c on q.vec_id <> c.vec_id and q.vec_id % 20 = 0
            )
            select query_id, cast(row_number() over (partition by query_id order by distance, neighbor_id)
                   as bigint) as rank, neighbor_id, distance
            from pairs qualify rank <= 10""",
        "op10_exact_dedup": """
            with norm as (
              select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') as norm
              from documents
            ),
            groups as (select norm, max(doc_id) as keep_id, count(*) as group_size from norm group by 1)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
            from norm join groups using (norm)""",
            "op12_remove_passages": r"""
            with docs as (
              select row_number() over () as row, doc_id,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
              from documents
            ),
            words as (select row, unnest(words) as word, generate_subscripts(words, 1) as i from docs),
            windows as (
              select row, i, word, sha256(string_agg(word, ' ') over w) as content, count(*) over w as n
              from words window w as (partition by row order by i rows between current row and 34 following)
            ),
            judged as (
              select row, i, word, n = 35 and count(*) over (partition by content, n) > 1 as again from windows
            ),
            covered as (
              select row, i, word, bool_or(again) over w as gone, bool_or(again) over before as gone_before
              from judged window
                w as (partition by row order by i rows between 34 preceding and current row),
                before as (partition by row order by i rows between 35 preceding and 1 preceding)
            ),
            kept as (
              select row, count(*) filter (where gone) as n_removed,
                     count(*) filter (where gone and not coalesce(gone_before, false)) as n_spans,
                     string_agg(word, ' ' order by i) filter (where not gone) as text
              from covered group by row
            )
            select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
                   coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept.text, '')) as kept_sha256
            from docs left join kept using (row)""",
        "op13_collocations": r"""
            with texts as (
              select coalesce(lang, 'und') as lang,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
              from documents
            ),
            pieces as (
              select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts
            ),
            split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
            totals as (select lang, cast(sum(len(words)) as bigint) as n from split group by 1),
            grams as (
              select lang, m, words[i : i + m - 1] as words
              from (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i
                    from split, (select unnest([1, 2, 3, 4, 5]) as m) where len(words) >= m)
            ),
            f as (select lang, m, words, count(*) as a from grams group by all having a >= 100),
            inside as (
              select lang, m2 as m, words[i : i + m2 - 1] as words, max(a) as a
              from (select lang, m2, words, a, unnest(range(1, m - m2 + 2)) as i
                    from f, (select unnest([2, 3, 4]) as m2) where m2 < m) group by all
            ),
            candidates as (
              select f.* from f left join inside i on i.lang = f.lang and i.words = f.words
              where f.m > 1 and (i.a is null or 100 * i.a < 100 * f.a)
            ),
            cuts as (
              select c.lang, c.words, c.a, x.a as l, y.a as r, t.n, k,
                     (cast(1000 as hugeint) * c.a * t.n) // (cast(x.a as hugeint) * y.a) as score
              from (select *, unnest(range(1, m)) as k from candidates) c
              join f x on x.lang = c.lang and x.words = c.words[1 : k]
              join f y on y.lang = c.lang and y.words = c.words[k + 1 :]
              join totals t on t.lang = c.lang
            ),
            weakest as (
              select * from cuts qualify row_number() over (partition by lang, words order by score, k) = 1
            ),
            ranked as (
              select lang, array_to_string(words, ' ') as phrase, a, l, r, n, cast(score as bigint) as score,
                     row_number() over (partition by lang
                       order by score desc, a desc, array_to_string(words, ' ')) as rank
              from weakest
            )
            select * from ranked where rank <= 2000""",
    }
