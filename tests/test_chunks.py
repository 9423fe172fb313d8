"""Chunks of texts made of known grapheme clusters, against a plain splitter."""

import random

import pytest

from larkspur.operators import chunk

CLUSTERS = ["a", "b", "ß", "ẹ́", "🇩🇪", "🇫🇷", "👨‍👩‍👧‍👦", "👍🏽", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "각", "각", "数", "नि", "x‍"]


def text_of(rng, n, blanks):
    """A text and the places where its clusters begin."""
    out, at, starts = "", 0, {0}
    for _ in range(n):
        c = rng.choice(blanks) if rng.random() < 0.25 else rng.choice(CLUSTERS)
        out += c
        at += len(c)
        starts.add(at)
    return out, starts


def plain(text, starts, max_bytes):
    """Parts of one paragraph, byte by byte."""
    size = lambda a, b: len(text[a:b].encode())
    skip = lambda k: next((j for j in range(k, len(text)) if not text[j].isspace()), len(text))
    out, at = [], 0
    while at < len(text):
        if size(at, len(text)) <= max_bytes:
            out.append((at, len(text)))
            break
        fit = max(k for k in range(at, len(text) + 1) if size(at, k) <= max_bytes)
        spaces = [k for k in range(at + 1, fit + 1) if text[k].isspace() and text[k] != "\u00a0" and skip(k) in starts]
        cut = max(spaces, default=None) or max((k for k in range(at + 1, fit + 1) if k in starts), default=None)
        if cut is None:
            return None
        out.append((at, at + len(text[at:cut].rstrip())))
        at = skip(cut)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_paragraphs_are_cut_between_clusters(seed):
    rng = random.Random(seed)
    text, starts = text_of(rng, 80, [" ", "\u00a0", "  "] if seed % 2 else [" "])
    text, shift = text.strip(), len(text) - len(text.lstrip())
    starts = {k - shift for k in starts}
    for limit in (3, 12, 30, 64, 10_000):
        want = plain(text, starts, limit)
        if want is None:
            with pytest.raises(ValueError, match="longer than"):
                chunk.split_text(text, chunk.Policy(max_bytes=limit))
        else:
            assert [(a, b) for _, a, b in chunk.split_text(text, chunk.Policy(max_bytes=limit))] == want


def test_overlap_begins_at_a_word():
    text = "one two three four " + "👨‍👩‍👧‍👦 éx five six seven eight nine ten"
    p = chunk.Policy(max_bytes=40, overlap_bytes=14)
    got = chunk.split_text(text, p)
    assert len(got) > 2
    for k, (_, a, b) in enumerate(got):
        assert len(text[a:b].encode()) <= 40
        assert a == 0 or text[a - 1] == " "
        assert k == 0 or a <= got[k - 1][2] + 1


def test_long_paragraph_is_linear():
    text = "word " * 200_000
    got = chunk.split_text(text, chunk.Policy(max_bytes=2_048))
    assert len(got) == -(-len(text.strip()) // 2_048) or len(got) > 480
    assert "".join(text[a:b].replace(" ", "") for _, a, b in got) == "word" * 200_000


def test_job_names_the_document_that_is_refused(spark):
    t = spark.createDataFrame([(1, "fine"), (2, "e" + "́" * 3000)], "doc_id long, text string")
    with pytest.raises(Exception, match="doc_id 2"):
        chunk.chunks(t).collect()
    assert chunk.chunks(t.where("doc_id = 1")).count() == 1
