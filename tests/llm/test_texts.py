"""Operators that work document by document: licences, URLs, media, tokens, HTML, toxicity."""

import hashlib
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe_lexicon, html_extract, license_scan, progressive_jpeg, token_count, toxicity, url_filter

DOCS = "doc_id long, text string, score string, size int"  # with columns whose names clash
ODD = [(1, None, "x", 1), (2, "", "x", 1), (3, "a", None, None), (3, "a", None, None), (None, "Licensed under the MIT License.", "x", 1), (4, "All rights reserved. " * 3000, "x", 1)]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
texts = st.text(st.characters(exclude_categories=("Cs",)), max_size=60) | st.lists(st.sampled_from(["'s", "'re", "'l", " ", "\n", "\t ", "a", "Bc", "é", "12", "½", "_", "!?", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "中", "\u0301", "\x1c", "\xa0"]), max_size=12).map("".join)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---------------------------------------------------------------- 4


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@given(st.lists(st.sampled_from(["cc", "CC", "by", "-", " ", "general", "public", "License", "all", "rights", "reserved", ".", "é", "x", "\x00", "İ"]), max_size=25).map("".join) | texts)
@settings(max_examples=300, deadline=None)
def test_licence_base_against_brute_force(text):
    index = license_scan.LicenceIndex.build(0, {})
    assert license_scan.scan_text(text, index)[:5] == brute_licence(text)


def test_licence_labels_against_all_places():
    """The index finds what trying every template at every place finds."""
    rng = random.Random(8)
    frequency = {w: rng.randrange(900) for w in sorted(license_scan.VOCABULARY)}
    index = license_scan.LicenceIndex.build(1000, frequency)
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                words[rng.randrange(len(words))] = rng.choice(("x", "the", "license"))
            parts += [*words, *rng.choices(("the", "of", "software", "x1", "license", "version", "public"), k=rng.randrange(12))]
        words = license_scan._WORD.findall(license_scan.lowered(" ".join(parts)))
        expected = {}
        for t, label in enumerate(index.labels):
            share = max((index.verify(t, o, words) for o in range(-len(index.words[t]), len(words) + 1)), default=0)
            if share >= index.min_cover:
                expected[label] = max(expected.get(label, 0), share)
        found = index.matches(words)
        # A place next to an aligned one may cover more words.
        assert found.keys() == expected.keys() and all(0.75 <= v <= expected[k] for k, v in found.items())


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("MIT License\n\nCopyright (c) 2020 X", "mit"), ("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("Apache License\n Version 2.0, January 2004", "apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "gpl,gpl-2"), ("He went to MIT without a license", ""), ("the identifier of the license", ""), ("", ""),
    ],
)
def test_licence_titles_and_tags(text, labels):
    assert license_scan.scan_text(text, license_scan.LicenceIndex.build(0, {}))[5] == labels


def test_licence_labels(spark):
    rows = [(1, "x y\nReleased under the MIT License.\nz"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "the license of the apache version"), (5, "licensed under the Apache License, Version 2.0")]
    found = by_id(license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [found[i]["labels"] for i in (1, 2, 3, 4, 5)] == ["mit", "cc-by,cc-by-nc", "gpl,gpl-3", "", "apache-2.0"]
    assert found[4]["score"] == 0 and found[1]["score"] == 1
    odd = license_scan.scan_licences(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(odd) == len(ODD) and {r["n_words"] for r in odd if r["doc_id"] in (1, 2)} == {0} and next(r for r in odd if r["doc_id"] == 4)["n_base"] == 3000
    assert license_scan.scan_licences(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://x.com", "x.com", "", None, "allow"), ("http://xcom/", "xcom", "/", None, "allow"),
        ("https://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), ("https://a.net?x=/es/", "a.net", "", None, "allow"), ("https://spam-farm.example.org/en/1", "spam-farm.example.org", "/en/1", None, "block"),
        ("https://cheaper-pillows.org/", "cheaper-pillows.org", "/", None, "allow"), ("https://cheap.org/free", "cheap.org", "/free", None, "block"), ("https://cheap-cheap.org/", "cheap-cheap.org", "/", None, "allow"),
    ],
)
def test_urls(url, host, path, rule, verdict):
    assert url_filter.UrlFilter().judge(url)[:4] == (host, path, rule, verdict)


def test_url_table(spark):
    pages = spark.createDataFrame([(1, None, "v"), (1, None, "v"), (None, "x://y.com/", "v")], "page_id long, url string, verdict string")
    assert [r["verdict"] for r in url_filter.judge_urls(pages).collect()] == ["allow"] * 3
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 2


@given(st.binary(max_size=900))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data):
    payload = data + b" " * (-len(data) % 192 if data else 192)
    image = progressive_jpeg.read_coefficients(progressive_jpeg.write_payload(payload))
    assert progressive_jpeg.read_payload(image) == payload


def test_media_scans_bit_by_bit(monkeypatch):
    """Unpacked fields and the bitwise reader agree, coefficient by coefficient."""
    media = progressive_jpeg.write_payload(os.urandom(192 * 25))
    fast = progressive_jpeg.read_coefficients(media)
    init = progressive_jpeg._Table.__init__

    def without_only(self, counts, symbols):
        init(self, counts, symbols)
        self.only = None

    monkeypatch.setattr(progressive_jpeg._Table, "__init__", without_only)
    slow = progressive_jpeg.read_coefficients(media)
    assert all(np.array_equal(a.coefficients, b.coefficients) for a, b in zip(fast.components, slow.components))


def test_inverse_transform_and_colour():
    """A flat grey block, and the transform against its definition."""
    component = progressive_jpeg.Component(1, 1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int16))
    component.coefficients[0, 0] = 80
    image = progressive_jpeg.Image(8, 8, [component], {0: np.ones(64)}, [])
    assert (progressive_jpeg.to_rgb(image) == 138).all()
    rng = np.random.default_rng(1)
    component.coefficients[0] = rng.integers(-30, 30, 64)
    plain = np.zeros((8, 8))
    natural = np.zeros(64)
    natural[progressive_jpeg.ZIGZAG] = component.coefficients[0]
    c = lambda k: np.sqrt(0.5) if k == 0 else 1
    for y in range(8):
        for x in range(8):
            plain[y, x] = sum(c(u) * c(v) / 4 * natural[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    assert np.abs(progressive_jpeg.to_rgb(image)[:, :, 0] - np.clip(plain + 128, 0, 255)).max() <= 1


def test_media_columns(spark):
    rows = by_id(progressive_jpeg.media_columns(spark.createDataFrame(ODD, DOCS), keep_tensor=True))
    for i in (1, 2, 3, 4):
        text = {1: "", 2: "", 3: "a", 4: ODD[-1][1]}[i]
        payload = text.encode() + b" " * (-len(text) % 192 if text else 192)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["rgb"]) == 3 * r["width"] * r["height"]
    assert rows[1]["feature"] == rows[2]["feature"]


# ---------------------------------------------------------------- 6 and 7


@given(st.lists(texts, max_size=6))
@settings(max_examples=200, deadline=None)
def test_token_counts_against_library(batch):
    library = Tokenizer.from_file(BYTE)
    assert token_count.transducer(BYTE).counts(batch).tolist() == [len(e.ids) for e in library.encode_batch(batch, add_special_tokens=False)] if batch else True


@given(st.lists(texts, max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoding_against_library(batch):
    library = Tokenizer.from_file(WORD)
    for text, (ids, decoded) in zip(batch, bpe_lexicon.lexicon(WORD).encode(batch)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected and decoded == library.decode(expected, skip_special_tokens=False)


def test_long_words_merge_exactly():
    library = Tokenizer.from_file(BYTE)
    for word in ("a" * 300, "ab" * 500, "xyzzy" * 77, "é" * 200):
        assert token_count.transducer(BYTE)[word] == len(library.encode(word, add_special_tokens=False).ids)


def test_chunks_compose():
    """Chunk state maps give the starts that a walk from left to right gives."""
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 9, 5000).astype(np.uint8)
    state, starts = token_count.X, []
    for i, k in enumerate(kinds):
        if token_count.STARTS[state * 9 + k]:
            starts.append(i)
        state = token_count.NEXT[state * 9 + k]
    for chunk in (1, 7, 128, 8192):
        assert token_count.pretoken_starts(kinds, chunk).tolist() == starts


def test_automaton_is_minimal_and_complete():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"s"})
    keys, targets, numbers, finals = bpe_lexicon.minimal_automaton(words)
    assert len(finals) == 7  # tap and top share their suffixes, with and without s
    lex = bpe_lexicon.Lexicon.__new__(bpe_lexicon.Lexicon)
    lex.keys, lex.targets, lex.numbers, lex.finals = keys, targets, numbers, finals
    assert lex.numbers_of(words).tolist() == list(range(len(words)))
    assert lex.numbers_of([b"ta", b"x", b"tapss", b""]).tolist() == [-1] * 4


def test_every_code_point_against_libraries():
    """Letters, numbers and lower case are those of the library, for all of Unicode."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    library = Tokenizer.from_file(WORD)
    batch = [f"a:{c}:a" for c in every]
    expected = [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]
    assert [list(struct.unpack(f"<{len(ids) // 4}I", ids)) for ids, _ in bpe_lexicon.lexicon(WORD).encode(batch)] == expected
    batch = [f"a:{c}a {c}{c} " for c in every]
    assert token_count.transducer(BYTE).counts(batch).tolist() == [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(batch, add_special_tokens=False)]


def test_lexicon_of_frequent_words(spark):
    """Words counted over all texts, with several ids each; every word's ids are the library's."""
    library = Tokenizer.from_file(WORD)
    rows = [(1, "Zyxwvutt zyxwvutt ÉTÉ été Straße"), (2, "straße zyxwvutt once"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # zyxwvutt stands three times, straße and été twice: two words more than a limit of 2 leaves for them.
    assert bpe_lexicon.frequent_words(docs, 9) == ["zyxwvutt", "straße", "été"]
    assert bpe_lexicon.frequent_words(docs, 2) == bpe_lexicon.frequent_words(docs, 9, least=3) == ["zyxwvutt"] and bpe_lexicon.frequent_words(docs, 0) == []
    merges = bpe_lexicon.Merges(WORD)
    words = ["zyxwvutt", "straße", "été", "the"]
    lex = bpe_lexicon.Lexicon(WORD, bpe_lexicon.compiled(merges, words))
    assert (lex.numbers_of([w.encode() for w in words]) >= 0).all() and lex.ids_of(words) == {w: library.encode(w, add_special_tokens=False).ids for w in words}
    assert max(map(len, lex.ids_of(words).values())) > 1 
    assert lex.numbers_of([b"unseenword"]).tolist() == [-1] and lex.ids_of(["unseenword"]) == {"unseenword": library.encode("unseenword", add_special_tokens=False).ids}
    assert bpe_lexicon.Lexicon(WORD, bpe_lexicon.compiled(merges, [])).numbers_of([b"a"]).tolist() == [-1]


def test_transducer_emits_counts_on_transitions():
    """Sums along transitions are the counts of merging, also where few states are kept."""
    rng, machine = random.Random(3), token_count.transducer(BYTE)
    small = token_count.Transitions(machine.merges, most_states=20)
    for _ in range(3000):
        word = "".join(rng.choice(rng.choice(("abcde", "etaoin shrdlu", "=-_*", "éß中α😀 "))) for _ in range(rng.randint(1, 30)))
        count = len(machine.merges.merge(word))
        assert machine.transitions.count(word.encode()) == count == small.count(word.encode())
    assert len(small.states) <= 21 and min(e for _, e in machine.transitions.steps.values()) < 0


def test_deep_and_broken_pages_take_linear_time():
    model = html_extract.trained()
    for page in ("<p>x" + "<i></b>" * 200_000, "".join(f"<div class='c{i}'>t{i} " for i in range(100_000)), "<div>" * 200_000 + "x"):
        start = time.perf_counter()
        html_extract.main_text(page, model)
        assert time.perf_counter() - start < 20


def test_token_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    counts = by_id(token_count.count_tokens(docs, BYTE))
    assert (counts[1]["n_tokens"], counts[2]["n_tokens"], counts[3]["n_tokens"], counts[4]["over_limit"]) == (0, 0, 1, True)
    coded = by_id(bpe_lexicon.encode_decode(docs, WORD))
    assert coded[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and coded[3]["n_tokens"] == 1
    assert bpe_lexicon.encode_decode(docs.limit(0), WORD).count() == token_count.count_tokens(docs.limit(0), BYTE).count() == 0


# ---------------------------------------------------------------- 10


def test_blocks_of_broken_markup():
    found = [b.text for b in html_extract.leaf_blocks("<p>a&nbsp;b<br>c<p>d &amp e &amq; <b>f</p><script>x<p></script><div>g<!-- <p> -->h</div><p title='>'>i<p tit")]
    assert found == ["a b c", "d & e &amq; f", "gh", "i"]
    assert html_extract.leaf_blocks("") == [] and html_extract.leaf_blocks("<title>t</title><style>p</style>") == []


def test_blocks_of_a_head_without_end_tag():
    head = "<!doctype html><html><head><meta charset=utf-8><title>t</title><link rel=x><style>p{}</style><script>1</script><template><p>no</template>\n"
    texts = lambda html: [b.text for b in html_extract.leaf_blocks(html)]
    for start in ("", "<body>", "</head>", "</head><body>"):
        assert texts(f"{head}{start}<article><h1>One</h1><p>Two</article>") == ["One", "Two"]
    assert texts(f"{head}Plain <b>text</b><p>Two") == ["Plain text", "Two"] and texts(f"{head}<img src=x><a href=y>Link</a>") == ["Link"]
    assert texts("<head><title>t</title><head><p>Two") == ["Two"] and texts(f"{head}</html>") == []
    article, model = "<article><h1>Title</h1><p>One two.</p><p>Short</p></article>", html_extract.trained()
    assert html_extract.main_text(f"{head}{article}", model) == html_extract.main_text(f"{head}</head><body>{article}</body></html>", model) == "Title\n\nOne two.\n\nShort"


def test_field_learns_held_out_pages():
    model, wrong, total = html_extract.trained(), 0, 0
    for html, truth in html_extract.labelled_pages(150, seed=4242):
        found = model.decode(html_extract.features(html_extract.leaf_blocks(html)))
        assert len(found) == len(truth)
        wrong += sum(a != b for a, (_, b) in zip(found, truth))
        total += len(truth)
    assert wrong / total < 0.01


def test_viterbi_against_all_paths():
    rng = random.Random(1)
    field = html_extract.ChainField({n: (rng.random(), rng.random()) for n in "abcd"}, ((rng.random(), rng.random()), (rng.random(), rng.random())))
    for n in range(1, 8):
        sequence = [[rng.choice("abcd")] for _ in range(n)]
        score = lambda y: sum(field.weights[s[0]][k] for s, k in zip(sequence, y)) + sum(field.moves[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(([i >> k & 1 for k in range(n)] for i in range(1 << n)), key=score)
        assert field.decode(sequence) == best


def test_pages(spark):
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie'>We use cookies.</div><article><h1>Title</h1><p>One  two.</p><p>Short</p></article><section id='comments'><p>Nice post!</p></section><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", html, "t"), (2, None, None, "t"), (3, "u", "", "t")]
    found = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert found[1]["text"] == "Title\n\nOne two.\n\nShort" and found[1]["n_chars"] == 22 and found[2]["text"] == found[3]["text"] == "" and found[2]["n_chars"] == 0


SAID = "The quick brown fox jumps over the lazy dog and runs away again. "


@pytest.mark.parametrize(
    ("html", "labels"),
    [
        (f"<article><p>{SAID}</p></article>", "1"), (f"<p>{SAID}</p><p>{SAID * 2}</p>", "11"), (f"<html><body><h1>Head</h1><p>{SAID}</p></body></html>", "11"), ("<article><h1>T</h1><p>Yes.</p><p>No!</p></article>", "111"),
        (f"<div class='content'><h2>T</h2><p>{SAID}</p></div><div class='sidebar'><p>{SAID}</p></div><footer>c</footer>", "1100"), (f"<div class='cookie-banner'><p>{SAID}</p></div><article><p>{SAID}</p></article>", "01"),
        (f"<nav><a href=/>Home</a></nav><main><h1>T</h1><p>{SAID}</p><ul><li>a b</li><li>c d</li></ul><blockquote>{SAID}</blockquote><pre>code()</pre></main><aside>{SAID}</aside>", "01111110"),
        (f"<article><h1>T</h1><p>{SAID}</p><div class='comment-list'><p>{SAID}</p></div></article>", "110"), (f"<article><h1>T</h1><p>{SAID}</p></article><div id='comments'><p>{SAID}</p></div>", "110"),
    ],
)
def test_pages_written_by_hand(html, labels):
    model = html_extract.trained()
    assert "".join(map(str, model.decode(html_extract.features(html_extract.leaf_blocks(html, model.known))))) == labels


def test_pages_repeat_and_may_be_none(spark):
    shape = "page_id long, url string, html string"
    rows = [(1, "u", "<article><p>One two three.</p></article>")] * 2 + [(None, None, "<p>" + "word " * 200_000)]
    found = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html_extract.extract(spark.createDataFrame(rows, shape)).collect()))
    assert found[1:] == [(1, 14), (1, 14)] and html_extract.extract(spark.createDataFrame([], shape)).count() == 0


# ---------------------------------------------------------------- 1


def test_toxicity_of_odd_tables(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (None, None), (3, ""), (4, "fine words " * 20_000)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0 and toxicity.without_toxic(docs, labels).count() == 5


def test_isotonic_against_definition():
    rng = np.random.default_rng(3)
    score, y = rng.integers(0, 20, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    places, values = toxicity.isotonic(score, y)
    assert (np.diff(values) >= 0).all() and list(places) == sorted(set(score))
    # Min-max formula of isotonic regression.
    sums = np.array([y[score == p].sum() for p in places])
    n = np.array([(score == p).sum() for p in places])
    for i in range(len(places)):
        expected = max(min(sums[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(places))) for a in range(i + 1))
        assert values[i] == pytest.approx(expected)


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(4)
    clean = "the house and garden were quiet while rain fell on old stone walls near river".split()
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "blarg", "scum"]))
        rows.append((i, " ".join(words), "s", i))
        labels.append((i, int(toxic)))
    rows += [(None, None, "s", 0), (5000, "", "s", 0), (5001, "you idiot scum " * 2000, "s", 0)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = [r for r in toxicity.toxicity(docs, known).collect()]
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    truth = dict(labels)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None) and len(held) > 150
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in found)
    nothing = toxicity.toxicity(docs, known.limit(0)).agg(F.max("score")).first()[0]
    assert nothing == 0
