import hashlib
import html
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T


def reference_clean(s):
    s = unicodedata.normalize("NFKC", html.unescape(s)).replace("\0", " ")
    return re.sub(r"\s+", " ", s).strip()


@given(st.text())
@settings(max_examples=300)
def test_clean_is_the_four_steps(s):
    assert T.clean(s) == reference_clean(s)


def test_white_space_example():
    assert T.clean(" alpha\n\n beta\t gamma ") == "alpha beta gamma"


@given(st.one_of(st.text(), st.text(st.characters(max_codepoint=127)), st.text("aZ9_ &;#x41é漢々½\0\t ")))
@settings(max_examples=500)
def test_words_are_those_of_the_cleaned_text(s):
    assert T.words(s) == re.findall(f"[{T.HAN}]|[^\\W_{T.HAN}]+", reference_clean(s).lower())


def test_words():
    assert T.words("A&amp;B Ｃ-3 它们x 1") == ["a", "b", "c", "3", "它", "们", "x", "1"]
    assert T.words("") == [] and T.alnum("Ab-1_ é") == "ab1é"


def test_columns(spark, rows):
    df = spark.createDataFrame([(1, " a&lt;b\0 c "), (2, None), (3, "")], "id int, t string")
    assert rows(df.select("id", T.clean_text(F.col("t")))) == [(1, "a<b c"), (2, None), (3, "")]
    h = hashlib.sha256("ü".encode()).hexdigest()
    got = spark.createDataFrame([("ü",)], "t string").select(T.document_hash(F.col("t")).alias("h"))
    assert got.first().h == h
    assert got.select(T.hash_fraction(F.col("h")).alias("f")).first().f == int(h[:16], 16) / float(16**16 - 1)
    with pytest.raises(ValueError):
        T.split_of(F.col("h"), 2)
    assert got.select(T.split_of(F.col("h"), 0).alias("a"), T.split_of(F.col("h"), 1).alias("b")).first() == ("train", "validation")


def test_collapse_space_is_python_space(spark):
    odd = [c for c in map(chr, range(0x3100)) if re.match(r"\s", c)]
    df = spark.createDataFrame([(f"a{c}{c}b{c}",) for c in odd], "t string")
    assert {r[0] for r in df.select(T.collapse_space(F.col("t"))).collect()} == {"a b"}


def test_small_functions(spark):
    df = spark.createDataFrame([("x" * 10, "  7a12 ", 3725, float("inf"))], "t string, n string, s long, d double")
    r = df.select(T.truncate(F.col("t"), 6), T.number_in(F.col("n")), T.clock(F.col("s")), T.finite(F.col("d")), T.first_text(F.lit(" "), F.lit(None), F.lit(" b ")), T.token_estimate(F.col("t")), T.token_estimate(F.lit(""))).first()
    assert tuple(r) == ("xxx...", 7, "01:02:05", None, "b", 2, 1)
    ids = spark.createDataFrame([("run-1/a.b",), ("../x",), ("/abs",), ("a/../b",), (None,)], "i string")
    assert [r[0] for r in ids.select(T.safe_id(F.col("i"))).collect()] == [True, False, False, False, False]


def test_redaction(spark):
    text = "Bearer abc.def  \n\n  sk-12345678 token=xyz; at /private/a/b api.internal job-0a1b2c3d\r\nend  "
    df = spark.createDataFrame([(text,), (None,), ("y" * 5000,)], "t string").select(T.redact(F.col("t")))
    got = [r[0] for r in df.collect()]
    assert got[0] == "Bearer [redacted]\n  [redacted-api-key] token=[redacted]; at [private-path] [internal-host] [provider-job]\nend"
    assert got[1] == "" and len(got[2]) == 4000 and got[2].endswith("...")


def test_canonical_hash_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1.5, "é"]}',), ('{"a":[1.5,"é"],"b":1}',), (None,)], "j string")
    a, b, c = [r[0] for r in df.select(T.canonical_hash(F.col("j"))).collect()]
    assert a == b and c is None


def test_traceback(spark):
    yes = ["x\nTraceback (most recent call last):\n", "TRACEBACK (MOST RECENT CALL LAST):", "ValueError: no", "at step 3 got torch.cuda.OutOfMemoryError: x", "a\nmy_exception: b", "Worker failed for exp-1", "0 valueERROR:"]
    no = ["fine", "", None, "ValueError", "no errors: none", 'File "a.py", line 3', "worker failed"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(yes + no)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(T.looks_like_traceback(F.col("t"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_unknown_splits_are_train(spark):
    df = spark.createDataFrame([(" Validation",), ("dev",), (None,), ("test",)], "s string")
    assert [r[0] for r in df.select(T.normal_split(F.col("s"))).collect()] == ["validation", "train", "train", "test"]


def test_a_line_end_is_no_part_of_an_id_or_digest(spark):
    df = spark.createDataFrame([("run-1\n", "a" * 64 + "\n"), ("run-1", "A" * 64)], "i string, d string")
    assert [tuple(r) for r in df.select(T.safe_id(F.col("i")), T.is_hex_digest(F.col("d"))).collect()] == [(False, False), (True, True)]
