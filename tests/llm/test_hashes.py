"""Words that a polynomial modulo 2**64 cannot tell apart, and columns whose names clash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import mixing, ngram_join, phrase_automata, textcore

COLUMNS = "doc_id long, text string, source string"


def complementary(size):
    """A word over a and b that cancels out against its complement (both are built by doubling), and that complement."""
    word = "a"
    while len(word) < size:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 16, 32, 64, 512, 1024, 4096])
def test_word_hashes(size):
    a, b = complementary(size)
    data = np.frombuffer(f"{a} {b} {a} x{a} é".encode(), np.uint8)
    starts, ends, _ = textcore.words_of(data, np.array([0, len(data)]))
    h = textcore.word_hashes(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 4


def test_word_hashes_do_not_depend_on_neighbours():
    words = [w.encode() for w in ("a", "ab", "abcdefgh", "abcdefghi", "a" * 31, "a" * 32, "a" * 33, "a" * 70, "ß", "𝄞")]
    alone = []
    for w in words:
        data = np.frombuffer(w, np.uint8)
        alone.append(textcore.word_hashes(data, np.array([0]), np.array([len(w)]))[0])
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = textcore.words_of(data, np.array([0, len(data)]))
    assert textcore.word_hashes(data, starts, ends).tolist() == alone and len(set(alone)) == len(words)
    assert not len(textcore.word_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)))


@pytest.mark.parametrize("size", [1024, 4096])
def test_complementary_words_are_different_words(spark, size):
    a, b = complementary(size)
    rest = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, f"{a} {rest}", "s"), (4, f"{b} {rest}", "s")], COLUMNS)
    joined = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert joined[1] == 1 and joined[2] == 2
    removed = {r.doc_id: r.n_removed for r in phrase_automata.phrase_dedup(spark.createDataFrame([(1, f"{a} {' '.join(rest.split()[:49])}", "s"), (2, f"{b} {' '.join(rest.split()[:49])}", "s")], COLUMNS)).collect()}
    assert removed == {1: 0, 2: 0}


def test_mix_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "_size", "_source_size", "_target", "_copies", "_turn", "_cut", "_row", "whole", "_source", "_name", "_doc", "need", "size"]
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), *(F.lit(c).alias(c) for c in names[3:]))
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", *names[7:], "_size", "_source_size", "_target", "_copies"]
    assert sorted(map(tuple, mixed.select("doc_id", "_size", "_copies").collect())) == sorted(map(tuple, plain.select("doc_id", "_size", "_copies").collect()))
    assert mixed.where(" or ".join(f"`{c}` <> '{c}'" for c in names[7:])).isEmpty()
    assert mixing.emit(docs).columns == names
