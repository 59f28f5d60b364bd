"""The operators of this subpackage as registered queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import block_max, chunk_recipes, count_tree, language_codes, line_quality, mixing, phrases, secret_ledger, shards, vantage
from riskweave.llm.common import read_table
from riskweave.llm.pieces import encode_texts
from riskweave.llm.token_counts import token_counts
from riskweave.llm.word_table import encode_words

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the shards in training order hold each sequence of token ids of every document."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return shards.training_order(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end=50_256)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that aren't held out."""
    return line_quality.document_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return encode_texts(read_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_ids=False)


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their word triples."""
    return count_tree.jaccard_components(read_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest embeddings of every twentieth one."""
    return vantage.nearest(read_table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken when the sources are mixed to their weights."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    return language_codes.label(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, from a ledger that starts empty."""
    return secret_ledger.scan_all(read_table(spark, sf_dir, "documents"))


def op10_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return chunk_recipes.exact_groups(read_table(spark, sf_dir, "documents")).drop("n_chunks")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document, from a table of distinct words."""
    return encode_words(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return block_max.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that stand together most."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_training_order": op1_training_order,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_jaccard_components": op4_jaccard_components,
    "op5_nearest": op5_nearest,
    "op6_token_counts": op6_token_counts,
    "op7_mix": op7_mix,
    "op8_language": op8_language,
    "op9_secrets": op9_secrets,
    "op10_exact_copies": op10_exact_copies,
    "op11_word_bpe": op11_word_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_copies": r"""
        with texts as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents
        ), named as (
            select doc_id, sha256(text) as text_sha256, cast(strlen(text) as bigint) as n_bytes from texts
        )
        select
            doc_id,
            min(doc_id) over same as keep_id,
            count(*) over same as group_size,
            doc_id = min(doc_id) over same as kept,
            text_sha256,
            n_bytes
        from named
        window same as (partition by text_sha256)
    """,
    "op12_ranked_search": r"""
        with words as (
            select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from documents
        ), asked as (
            select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark
        ), lengths as (
            select doc_id, count(*) as n from words group by doc_id
        ), corpus as (
            select count(*) as documents, cast(sum(n) as bigint) as total from lengths
        ), norms as (
            select doc_id, 100 - 90 + ((90 * n * documents) // total) as m from lengths, corpus
        ), counts as (
            select term, doc_id, count(*) as tf from words where term in (select term from asked) group by term, doc_id
        ), weights as (
            select term, cast(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) as bigint) as w
            from counts, corpus group by term, documents
        ), scores as (
            select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
            from asked join weights using (term) join counts using (term) join norms using (doc_id)
            group by item_id, doc_id
        ), ranked as (
            select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
            from scores where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= 10
    """,
    "op13_phrases": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece
            from documents
        ), split as (
            select lang, regexp_extract_all(piece, '[^ \t]+') as words from pieces
        ), grams as (
            select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase
            from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from split, (select unnest(range(1, 6)) as k))
        ), counts as (
            select lang, phrase, k, count(*) as f from grams group by lang, phrase, k having count(*) >= 100
        ), totals as (
            select lang, cast(sum(len(words)) as bigint) as n from split group by lang
        ), candidates as (
            select lang, phrase, f as a, k, string_split(phrase, ' ') as words from counts where k > 1
        ), inner_phrases as (
            select lang, a, array_to_string(words[i : i + s - 1], ' ') as phrase
            from (
                select lang, a, words, s, unnest(range(1, k - s + 2)) as i
                from (select lang, a, words, k, unnest(range(2, k)) as s from candidates)
            )
        ), alone as (
            select * from candidates c
            where not exists (select 1 from inner_phrases p where p.lang = c.lang and p.phrase = c.phrase and 100 * p.a >= 100 * c.a)
        ), cuts as (
            select lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') as head, array_to_string(words[cut + 1 : k], ' ') as tail
            from (select *, unnest(range(1, k)) as cut from alone)
        ), scored as (
            select c.lang, c.phrase, a, cut, h.f as l, t.f as r, n,
                cast((cast(1000 as hugeint) * a * n) // (cast(h.f as hugeint) * t.f) as bigint) as score
            from cuts c join counts h on h.lang = c.lang and h.phrase = c.head join counts t on t.lang = c.lang and t.phrase = c.tail
            join totals on totals.lang = c.lang
        ), best as (
            select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
        ), ranked as (
            select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as integer) as rank, phrase, a, l, r, n, score from best
        )
        select * from ranked where rank <= 2000
    """,
}
