"""Properties over generated inputs of the pieces that need no cluster."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm.chat_formatting import escape, unescape
from tarnflow.llm.line_dedup import Lines
from tarnflow.llm.suffix_dedup import repeated_starts
from tarnflow.llm.textbytes import ALNUM, NOT_SPACE, Lookup, Words, sliding_min, text_bytes

CONTROL = st.lists(st.sampled_from(["<|", "|>", "\\", "im_start", "im_end", "<|im_end|>", "x"])).map("".join)


@given(CONTROL | st.text())
def test_escaping_can_be_undone(text):
    shown = escape(text)
    assert unescape(shown) == text and "<|im_end|>" not in shown and "<|im_start|>" not in shown


@settings(deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aB é\t\n0-\x0b\x7f|ß")), max_size=6))
def test_words_and_lines(texts):
    raw, offs = text_bytes(pa.array(texts, pa.string()))
    for alphabet, pattern in ((NOT_SPACE, "[^\x20\x09-\x0d]+"), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        words = Words(raw, offs, alphabet)
        expected = [(k, w) for k, t in enumerate(texts) for w in re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        got = [(int(d), raw[a:b].tobytes().decode()) for d, a, b in zip(words.doc, words.starts, words.ends, strict=True)]
        assert [(k, re.sub("[A-Z]", lambda m: m[0].lower(), w)) for k, w in got] == expected
        seen = {}
        assert all(seen.setdefault(w, h) == h for (_, w), h in zip(expected, words.hash.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    lines = Lines(raw, offs)
    got = [(int(d), raw[a:b].tobytes().decode()) for d, a, b in zip(lines.doc, lines.begin, lines.end, strict=True)]
    assert got == [(k, x) for k, t in enumerate(texts) for x in (t or "").split("\n")]
    assert lines.size.tolist() == [len(x.strip(" \t\n\r\v\f").encode()) for _, x in got]


@given(st.lists(st.integers(0, 50), min_size=1), st.integers(1, 9))
def test_sliding_minimum(values, w):
    if w <= len(values):
        assert sliding_min(np.array(values), w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 2**64 - 1)))
def test_lookup(keys, values):
    look = Lookup(np.array(keys, np.uint64))
    found, place = look.find(np.array(values + keys, np.uint64))
    assert found.tolist() == [i for i, v in enumerate(values + keys) if v in set(keys)]
    assert look.keys[place].tolist() == [(values + keys)[i] for i in found]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=5).filter(lambda x: any(x)), st.integers(2, 8))
def test_repeats(parts, least):
    seen = [p[i : i + least] for p in parts for i in range(len(p) - least + 1)]
    got = repeated_starts(parts, least)
    assert [g.tolist() for g in got] == [[i for i in range(len(p) - least + 1) if seen.count(p[i : i + least]) > 1] for p in parts]
