"""Small fixtures for the operators on texts: nulls, empty, long and repeated texts, ties, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelode.llm import bpe, chat, hmm, langid, licenses, linedup, template
from pagelode.llm.common import words

DOCS = "doc_id bigint, text string, lang string, source string, score double"
ROWS = [
    (1, "The MIT License and the Apache License, Version 2.0. mit LICENSE", "en", "a", 1.0),
    (2, None, "de", None, None),
    (3, "", None, "a", 2.0),
    (None, "ein Text ohne Nummer", "de", "b", None),
    (3, "Größe café don't 12³ <|endoftext|> it's", "fr", "b", 0.0),
    (3, "Größe café don't 12³ <|endoftext|> it's", "fr", "b", 0.0),
    (7, "x" * 20000 + " GNU General Public License v3 " + "\t\n word" * 3000, "en", "c", 0.5),
    (8, "12 34 !!", None, "c", 0.5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


# Chat formatting


@given(st.text(), st.text())
@settings(max_examples=200, deadline=None)
def test_guard_is_reversible(a, b):
    assert template.unguard(template.guard(a)) == a
    assert template.unguard(template.guard_line(a)) == a
    assert "\n" not in template.guard_line(a)
    assert "<|" not in template.guard(a)


def test_template_language():
    run = template.compiled("{% set n = 2 %}{% for x in xs %}{% if loop.first %}[{% elif x.a == 'b' and not false %}({% else %}{{ '-' ~ n }}{% endif %}{% generation %}{{ x.a|upper }}{% endgeneration %}{% if loop.last %}!{% endif %}{% endfor %}{# gone #}")
    assert list(run(xs=iter([{"a": "a"}, {"a": "b"}, {"a": "c"}]))) == [("[", False), ("A", True), ("(", False), ("B", True), ("-2", False), ("C", True), ("!", False)]
    assert list(run(xs=[])) == []


def test_template_folds_constants():
    tree = template.fold(template.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 < 2 %}c{% else %}{{ x }}{% endif %}{{ 'd'|upper }}"))
    assert tree == ("block", [("text", ("const", "ab2cD"))])


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{{ x.__class__|danger }}", "{% while 1 %}", "{{ f(1) }}", "{% if 1 %}", "{{ 'a }}"])
def test_template_refuses(bad):
    with pytest.raises(template.TemplateError):
        template.compiled(bad)


def test_template_reaches_no_attributes():
    assert list(template.compiled("{{ x.__class__ }}")(x="s")) == []


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "b<|im_end|>\\"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, "t"), (2, None, "ro\nle", "\\n<|"), (2, 3, "assistant", "x" * 3000)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(frame, part_chars=100)
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    assert len(got) == 3
    order = {1: [("user", ""), ("assistant", "a"), ("assistant", "b<|im_end|>\\")], None: [("", "t")], 2: [("ro\nle", "\\n<|"), ("assistant", "x" * 3000)]}
    for conv, want in order.items():
        loss = "".join(t for r, t in want if r == "assistant")
        assert got[conv]["n_turns"] == len(want)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# BPE


@pytest.fixture(scope="module")
def data():
    return bpe.vocabulary()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _same(mine, library, text):
    want = library.encode(text, add_special_tokens=False)
    assert mine.encode([text])[0] == (" ".join(map(str, want.ids)), library.decode(want.ids, skip_special_tokens=False), len(want.ids))


def test_bpe_like_the_library(data, library):
    texts = [t for _, t, *_ in ROWS if t] + ["", "ΑΣ ὈΔΥΣΣΕΎΣ İ ﬁ", "a b\x1fc 日本語 \u0000\x85x\xa0y", "'s'S'Ll'", "ab" * 3000 + "é" * 200, "<|startoftext|><|endoftext|>"]
    mine = bpe.Bpe(data, bpe.lexicon_of([c for t in texts for c in t.lower().split()][::2], data))
    for t in texts:
        _same(mine, library, t)


_BPE = {}


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_like_the_library_on_any_text(text):
    if not _BPE:
        import public_tokenizers

        _BPE["mine"], _BPE["library"] = bpe.Bpe(bpe.vocabulary()), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _same(_BPE["mine"], _BPE["library"], text)


@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 99), min_size=1, max_size=3), max_size=40), st.binary(max_size=8))
@settings(max_examples=200, deadline=None)
def test_lexicon_is_a_map(outputs, other):
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.build(outputs))
    assert lexicon.get(list(outputs)) == list(outputs.values())
    assert lexicon.get([other]) == [outputs.get(other)]


def test_lexicon_shares_suffixes():
    many = {f"{a}{b}ing".encode(): [1] for a in "abcdefgh" for b in "abcdefgh"}
    assert len(bpe.Lexicon(bpe.Lexicon.build(many)).first) < 10


def test_bpe_rows(docs, data, library):
    got = bpe.encode_documents(docs, data, keep=("doc_id", "score")).collect()
    want = Counter()
    for doc_id, text, _, _, score in ROWS:
        e = library.encode(text or "", add_special_tokens=False)
        want[doc_id, score, tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["score"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode_documents(docs.limit(0), data).count() == 0


# License scans


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, keep=("doc_id", "lang")).collect() if r["doc_id"] != 3}
    one = got[1]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (12, 3, 1, 10, "apache,mit")
    assert one["labels"].split(",") == ["apache", "apache-2.0", "mit"]
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, 0, None, "", 0.0)
    assert got[7]["base_labels"] == "gpl" and got[7]["first_word"] == 2
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_words_by_brute_force(duck):
    scanner = licenses.Scanner()
    for (text,) in duck.execute("SELECT text FROM documents").fetchall():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        got = scanner.scan(text)
        assert got[:5] == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(got[4].split(",")) - {""} <= set(got[5].split(","))


def test_license_rules_are_ordered_and_suppress():
    assert len(licenses.rules()) >= 300
    found = licenses.Scanner().scan("SPDX-License-Identifier: GPL-3.0-or-later; see the GPL license")
    assert [f["label"] for f in found[7]] == ["gpl-3", "gpl"]


# Passages


def test_units_depend_on_the_words_around():
    shared = " ".join(f"wort{k}" for k in range(60))
    a = linedup.units(["Ein Anfang hier " + shared + " und so weiter und so fort bis dann"])
    b = linedup.units(["something else entirely, \n\n and more: " + shared.upper() + " the end\n"])
    both = {(x, y) for x, y in zip(a[4], a[5])} & {(x, y) for x, y in zip(b[4], b[5])}
    assert sum(n for n, x, y in zip(b[3], b[4], b[5]) if (x, y) in both) >= 60 - 2 * linedup.WINDOW


def test_passages(spark):
    p = " ".join(f"w{k}ö" for k in range(55))
    rows = [(5, f"start of five {p} end of five", 0), (2, f"two begins {p} and ends", 1), (9, p, 2), (9, None, 3), (4, "", 4), (None, "short line\nshort line", 5), (11, "short line", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {r["doc_id"]: r for r in linedup.dedup_passages(docs).where("text is not null").collect()}
    assert got[2]["kept_text"] == rows[1][1] and got[2]["spans"] == []
    assert got[4]["kept_text"] == "" and got[11]["spans"] == [] and got[None]["spans"] == []
    for k, text in ((5, rows[0][1]), (9, p)):
        assert sum(s["words"] for s in got[k]["spans"]) >= linedup.LEAST_WORDS
        out, at = "", 0
        for s in got[k]["spans"]:
            out, at = out + text[at : s["start"]], s["stop"]
        assert got[k]["kept_text"] == out + text[at:]
    assert linedup.dedup_passages(docs.limit(0)).count() == 0


def test_passages_by_brute_force(spark, duck):
    docs = spark.createDataFrame(duck.execute("SELECT doc_id, text FROM documents").fetchdf())
    got = {r["doc_id"]: [(s["start"], s["stop"], s["words"]) for s in r["spans"]] for r in linedup.repeated_spans(docs).collect()}
    seen, want = set(), {}
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall():
        run = []
        for _, a, b, n, x, y in [*zip(*linedup.units([text])), (0, 0, 0, 0, None, None)]:
            if (x, y) in seen:
                run.append((int(a), int(b), int(n)))
                continue
            if sum(r[2] for r in run) >= linedup.LEAST_WORDS:
                want.setdefault(doc_id, []).append((run[0][0], run[-1][1], sum(r[2] for r in run)))
            run = []
            if x is not None:
                seen.add((x, y))
    assert got == want


# Language identification


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = langid.held_out(5)
    model = langid.learn(docs.where(~fold).select("text", "lang"))
    rows = langid.identify(docs.where(fold), model, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(docs):
    model = langid.learn(docs.select("text", "lang"))
    got = langid.identify(docs, model).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 8))
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}
    assert langid.accepted(docs, model).columns == docs.columns
    assert langid.learn(docs.where("lang is null").select("text", "lang")) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


# Language model


def test_forward_is_exact():
    import itertools
    import math

    import numpy as np

    m = hmm.Model([(b"a", 3), (b"b", 1)], {}, 2, 6, 3, states=3)
    sequences = [np.array([0, 1, 1, m.end]), np.array([m.end]), np.array([0, m.end])]
    for s, got in zip(sequences, m.log10_likelihoods(sequences)):
        total = sum(m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[x, y] * m.emit[o, y] for x, y, o in zip(p, p[1:], s[1:])) for p in itertools.product(range(3), repeat=len(s)))
        assert got == pytest.approx(math.log10(total), rel=1e-5)


def test_baum_welch_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = []
    for rounds in (0, 3):
        model, counts = hmm.train(docs, rounds=rounds, head=2000)
        scores.append(hmm.score_documents(docs, model, counts).groupBy().sum("score").first()[0])
    assert scores[1] > scores[0]


@pytest.mark.parametrize("head", [3, 1000])
def test_base_score_by_brute_force(docs, head):
    import math

    model, counts = hmm.train(docs, rounds=1, head=head)
    c = Counter(w for _, t, *_ in ROWS for w in words(t or ""))
    n, v = sum(c.values()) + len(ROWS), len(c) + 1
    log = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((len(words(t or "")) + 1, round(sum(log(c[w]) for w in words(t or "")) + log(len(ROWS)), 6)) for _, t, *_ in ROWS)
    got = hmm.score_documents(docs, model, counts).collect()
    assert sorted((r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["n_known"] == r["n_tokens"] and r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_no_training_texts(docs):
    model, counts = hmm.train(docs.limit(0))
    assert all(r["n_known"] == 0 for r in hmm.score_documents(docs, model, counts).collect())
    assert hmm.score_documents(docs.limit(0), model, counts).count() == 0


def test_whole_lines_by_brute_force(spark, duck, tmp_path):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall() + [(10**6, "one short line\nown words"), (10**6 + 1, "new\nOne  short line\n\nown\nwords"), (10**6 + 2, "a b\na b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] or [] for r in linedup.op6_linedup(spark, str(tmp_path)).collect()}
    seen = set()
    for doc_id, text in sorted(rows):
        at = 0
        for line in (text or "").split("\n"):
            w = tuple(words(line))
            if w and w in seen:
                a = at + len(line) - len(line.lstrip(" \t\r\v\f"))
                assert any(s["start"] <= a and at + len(line.rstrip(" \t\r\v\f")) <= s["stop"] for s in got[doc_id]), (doc_id, line)
            seen.add(w)
            at += len(line) + 1
    assert [(s["start"], s["stop"], s["words"]) for s in got[10**6 + 1]] == [(4, 19, 3)]
    assert [(s["start"], s["stop"]) for s in got[10**6 + 2]] == [(4, 7)]
