"""The keyword prefilter of the licence scan loses no match."""

import re

import pytest

from pagelode.llm import licenses


@pytest.mark.parametrize("text, label", [("released under Apache 2.0", "apache-2.0"), ("this is GPL v3", "gpl-3"), ("GNU General Public version 2 or later", "gpl-2"), ("BSD 3-clause", "bsd-3-clause"), ("MPL 1.1 code", "mpl-1.1")])
def test_names_with_versions_need_no_licence_word(text, label):
    assert label in licenses.Scanner().scan(text)[5].split(",")


def test_prefilter_against_all_rules():
    every = licenses.Scanner()
    every.by_keyword = {w: list(range(len(every.rules))) for w in every.by_keyword}
    gated = licenses.Scanner()
    for label, names, versions in licenses._FAMILIES:
        for name in re.split(r"\|(?![^(]*\))", names):
            shortest, longest = re.sub(r"\(\?:[^)|]*\)\?|\(\?:[^)]*\)\?", "", name), re.sub(r"\(\?:([^)|]*)[^)]*\)\??", r"\1", name)
            for n in (re.sub(r"\(\?:([^)|]*)[^)]*\)", r"\1", shortest), longest):
                for v in versions:
                    for text in (f"under {n} {v}", f"under {n} version {v} or later", f"{n} licence {v}"):
                        got = gated.scan(text)
                        assert f"{label}-{v.replace(' ', '-')}" in got[5].split(","), text
                        assert got == every.scan(text), text


def _alternatives(pattern):
    """Texts that a signature matches: each alternative, and optional parts left out and put in."""
    group = re.search(r"\(\?:([^()]*)\)(\?|\{(\d+),(\d+)\})?", pattern)
    if not group:
        return [pattern]
    parts = group[1].split("|") + [""] * (group[2] == "?")
    if group[3]:
        parts = [p * int(n) for p in parts for n in (group[3], group[4])]
    return [t for p in parts for t in _alternatives(pattern[: group.start()] + p + pattern[group.end() :])]


def test_keywords_stand_in_all_that_signatures_match():
    for label, keyword, sentence in licenses._SENTENCES:
        found = 0
        for text in _alternatives(f"(?:{sentence})" if "|" in re.sub(r"\([^()]*\)", "", sentence) else sentence):
            for t in (re.sub(r"([a-z ])\?", r"\1", text), re.sub(r"[a-z ]\?", "", text)):
                for shown, plain in (("[cs]", "c"), ("[sz]", "s"), ("[0-9]{4}", "1999"), ("[0-9 ]+", "1999 "), ("[0-9]", "4"), ("[a-z0-9]+", "some"), ("[a-z]+", "some")):
                    t = t.replace(shown, plain)
                if re.fullmatch(sentence, t):
                    found += 1
                    assert keyword in f" {t} ", (label, t)
        assert found, (label, sentence)
