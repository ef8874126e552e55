import fnmatch

import pytest
from pyspark.sql import functions as F

from symlattice.functions.filters import FilterError, compile_filter, matches, read_list
from symlattice.functions.hashing import MASK, combine, fnv1a, hex32, mix32

NAMES = ["", "a", "ab", "abc", "b", "a.b", "a/b", "foo_bar", "foo-bar", "[x]", "a]b", "a^b", "a\\b", "x*y", "A", "é", "a\nb"]


def kept(spark, expression, lists=None):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return {r["name"] for r in df.filter(compile_filter(expression, F.col("name"), lists)).collect()}


@pytest.mark.parametrize("glob", ["*", "a*", "*b", "a?b", "?", "[ab]", "[!ab]", "[]x]*", "a[]^]b", "[a-c]*", "foo[_-]bar", "a.b", "[x]", "a*b*"])
def test_globs_match_as_fnmatch_does(spark, glob):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r["name"] for r in df.filter(matches(F.col("name"), glob)).collect()} == {n for n in NAMES if fnmatch.fnmatchcase(n, glob)}


@pytest.mark.parametrize(("expression", "names"), [
    ("a | b", {"a", "b"}), ("a* & !*b", {"a", "abc", "a\nb"} - {"a\nb"}), ("!(a* | !a*)", set()), ("a | b & c", {"a"}), ("(a | b) & b", {"b"}), ("!!a", {"a"}), (":l & !a", {"b"}), ("a\\*b | x\\*y", {"x*y"}), ("[z", set()), ("a\\\\b", {"a\\b"}),
])
def test_expressions(spark, expression, names):
    assert kept(spark, expression, {"l": ["a", "b"]}) == names


@pytest.mark.parametrize("bad", ["", "a b", "(a", "a)", "a |", "& a", "!", ":", "()", "a & | b", ":missing", "a !b"])
def test_bad_expressions(bad):
    with pytest.raises(FilterError):
        compile_filter(bad, F.lit("x"), {"l": ["a"]})


def test_symbol_lists():
    assert read_list("zero\n[abi_symbol_list]\n one # first\n\n#two\n two\n[other]\nthree\n[more list]\none\nfour") == ["four", "one", "one # first", "two"]
    assert read_list("[x list]\nfoo#1\n  # no\n") == ["foo#1"]


def python_mix(x):
    x ^= x >> 16
    x = x * 0x21F0AAAD & MASK
    x ^= x >> 15
    x = x * 0xD35A2D97 & MASK
    return x ^ x >> 15


def test_hashes(spark):
    def fnv(text):
        h = 0x811C9DC5
        for b in text.encode():
            h = (h ^ b) * 0x01000193 & MASK
        return h

    texts = ["", "a", "interface", "é", "x" * 300]
    df = spark.createDataFrame([(t, i * 123456789 & MASK) for i, t in enumerate(texts)], "t string, n long")
    for r in df.select("t", "n", fnv1a(F.col("t")).alias("f"), mix32(F.col("n")).alias("m"), combine(F.col("n"), fnv1a(F.col("t"))).alias("c"), hex32(F.col("n")).alias("x")).collect():
        f = fnv(r["t"])
        assert (r["f"], r["m"]) == (f, python_mix(r["n"]))
        assert r["c"] == f ^ (r["n"] + 0x9E3779B9 + (f << 6) + (f >> 2) & MASK)
        assert r["x"] == f"0x{r['n']:08x}"
    assert fnv("interface") == 0x84EA5130


def test_filters_of_odd_words(spark):
    """Ranges that end before they begin match nothing, and a colon is a token of its own."""
    df = spark.createDataFrame([("z1",), ("a1",), ("-1",), ("b",), ("hidden",)], "s string")
    keep = lambda e, lists=None: sorted(r["s"] for r in df.filter(compile_filter(e, F.col("s"), lists)).collect())
    assert keep("[z-a]*") == [] and keep("[^z-a]") == ["b"] and keep("[a-]1") == ["-1", "a1"] and keep("[z-ab]*") == ["b"]
    assert keep(": l", {"l": ["hidden"]}) == ["hidden"]
    for bad in ("a:b", ":", ": &", "::l"):
        with pytest.raises(FilterError):
            compile_filter(bad, F.col("s"), {"b": [], "l": []})
