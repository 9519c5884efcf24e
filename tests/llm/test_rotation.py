"""Fill-in-the-middle by rotation: SQL, a plain version by slicing, round trips, odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import TEXTS
from trackfold.llm import block_rotation
from trackfold.llm.block_rotation import Rules

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(text, doc_id, rules=Rules()):
    """The definition, by slices of lines."""
    text = text or ""
    units = UNIT.findall(text)
    name = f"{rules.seed}:{'null' if doc_id is None else doc_id}"
    hexed = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rules.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < rules.spm else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), output


def test_odd_rows_with_all_columns(odd, empty):
    rules = Rules(seed=3, rate=80, spm=30)
    got = block_rotation.fill_in_middle(odd, rules, check=True)
    assert got.columns == [*odd.columns, "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = Counter((i, *plain(t, i, rules), t or "") for i, t, _, _ in TEXTS)
    assert Counter((r["doc_id"], *r[-6:]) for r in got.collect()) == want
    back = block_rotation.restore(got.drop("text"), "text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t, _, _ in TEXTS)
    assert {r["n"] for r in got.select("n").collect()} >= {0, 1}
    assert block_rotation.digests(empty).count() == 0


def test_clashing_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "x", "y")], "doc_id long, text string, output string, form string")
    got = block_rotation.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.first()["output"] == plain("a\nb\nc", 1)[4]


def test_whole_table(spark, documents, texts):
    got = block_rotation.digests(documents).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        want = plain(texts[r["doc_id"]], r["doc_id"])
        assert tuple(r)[1:5] == want[:4]
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(want[4]), sha(texts[r["doc_id"]] or ""))
    assert {r["form"] for r in got} >= {"psm", "spm"}


def test_long_texts_go_in_bounded_swaps(spark):
    long = "".join(f"line {k} of many é\n" for k in range(300_000)) + "no end"
    docs = spark.createDataFrame([(k, long) for k in range(3)], "doc_id long, text string")
    assert len(long) > 20 * block_rotation.SWAP_BYTES
    for r in block_rotation.fill_in_middle(docs, check=True).collect():
        assert tuple(r)[2:7] == plain(long, r["doc_id"]) and r["restored"] == long


@settings(max_examples=200, deadline=None)
@given(st.text("ab\né<>PSM", max_size=40), st.integers(0, 50))
def test_any_text_comes_back(text, doc_id):
    raw = text.encode()
    n, form, before, between, output = block_rotation.arranged(raw, doc_id, Rules())
    assert (n, form, before, between, output.decode()) == plain(text, doc_id)
    assert block_rotation.restored(output, form) == raw


def test_rotation():
    for left in range(6):
        for right in range(6):
            buffer = bytearray(b"0123456789abcdef")
            block_rotation.rotate(buffer, 2, 2 + left, 2 + left + right)
            block = b"23456789abcdef"
            assert buffer == b"01" + block[left : left + right] + block[:left] + block[left + right :]
