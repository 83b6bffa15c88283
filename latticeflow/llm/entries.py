"""Queries over the driver's tables that apply the operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeflow.llm.chat import digests
from latticeflow.llm.langid import page_languages
from latticeflow.llm.licenses import license_scan
from latticeflow.llm.mixing import taken_words
from latticeflow.llm.neardup import near_duplicates
from latticeflow.llm.ngram_join import ngram_components
from latticeflow.llm.packing import pack
from latticeflow.llm.tokencount import token_counts
from latticeflow.llm.toxicity import toxicity
from latticeflow.llm.vptree import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; text models come from the labelled documents."""
    return page_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the five-word shingle sets of all documents at Jaccard 0.8."""
    return ngram_components(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("evidence")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from the formatted text, and of one that quotes the format's marks."""
    text = "\\### Assistant: </turn> ok"
    quoting = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that all documents name."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("notices")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document a mix by source weights takes."""
    return taken_words(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of one label at cosine 0.93."""
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of all documents."""
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 1024 tokens."""
    return pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_COMPONENTS = "reach as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b), least as (select a, least(a, min(b)) as component_id from reach group by a)"
_TURNS = "select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, t.range, case t.range when 0 then 'user' else 'assistant' end, '\\### Assistant: </turn> ok' from range(2) t"
_FINE = "select vec_id, {more} embedding::double[] as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _dot(a: str, b: str) -> str:
    """Products added up one after the other."""
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda x, y: x + y)"


#: DuckDB SQL of the queries that it can express; the others learn, draw or tokenise, see tests/llm.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
g as (select doc_id, unnest(s) as g from s), n as (select doc_id, cast(len(s) as bigint) as n from s),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
link as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)), {_COMPONENTS}
select n.doc_id, n.n as n_shingles, coalesce(component_id, n.doc_id) as component_id from n left join least on least.a = n.doc_id""",
    "op4_chat_formatting": f"""with t as ({_TURNS}), e as (select *, 14 + 2*length(role) + 2*length(text) - length(translate(role, '\\#<:', '')) - length(translate(text, '\\#<:', '')) as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
cast(sum(chars) as bigint) as formatted_chars from e group by conv_id""",
    "op5_nearest_neighbours": f"""with f as ({_FINE.format(more="")}), u as (select *, {_dot("v", "v")} as n from f),
c as (select q.vec_id as query_id, r.vec_id, {_dot("q.v", "r.v")} / sqrt(q.n) / sqrt(r.n) as score from u q join u r on q.vec_id % 50 = 0 and r.vec_id <> q.vec_id and len(r.v) = len(q.v)),
o as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from c) select query_id, cast(rank as int) as rank, vec_id, score from o where rank <= 5""",
    "op8_embedding_near_dedup": f"""with recursive f as ({_FINE.format(more="label,")} and label is not null), u as (select *, {_dot("v", "v")} as n from f),
link as (select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v) and {_dot("x.v", "y.v")} / sqrt(x.n) / sqrt(y.n) >= 0.93), {_COMPONENTS}, k as (select a, count(*) as k from link group by a)
select e.vec_id, coalesce(k, 0) as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept from embeddings e left join least on least.a = e.vec_id left join k on k.a = e.vec_id""",
}
