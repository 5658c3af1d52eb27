import base64

import pytest

from weftline.llm import budget


def test_information_separators_are_no_white_space(tmp_path):
    pytest.importorskip("tiktoken")
    ranks = [bytes([k]) for k in range(256)] + [b"!\x1c", b"!\x1f"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % k for k, x in enumerate(ranks)))
    t = budget.BytePairs(str(tmp_path / "ranks"), budget.BYTE_PATTERN)
    for text in ("a!\x1cb" * 50, "a!\x1fb c" * 50, "word !\x1c\x1d. " * 50):
        whole = t.count([text])
        for size in range(1, 12):
            at = [0, *t.cuts(text, size), len(text)]
            assert [sum(t.count([text[a:b] for a, b in zip(at, at[1:])]))] == whole


def test_words_are_not_cut_before_separators():
    assert not budget.WordPairs.boundary.search("a!\x1cb")
    assert budget.WordPairs.boundary.search("a! b")
