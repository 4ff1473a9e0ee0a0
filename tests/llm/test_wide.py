"""Licence templates against regular expressions, their cost on long texts, and language models of several matrices."""

import re
import time

import numpy as np
import pytest

pytest.importorskip("recollect.llm")

from recollect.llm import language_id, license_scan  # noqa: E402


def expression(template):
    """The template as a regular expression over words that each end with a space."""
    out = ""
    for i, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2 == 0:
            out += "".join(re.escape(w.decode()) + " " for w in license_scan.words_of(part))
        elif part == "beginOptional":
            out += "(?:"
        elif part == "endOptional":
            out += ")?"
        else:
            out += r"(?:\S+ ){0,%d}" % int(part.rpartition("=")[2])
    return re.compile("(?:^| )" + out)


def example(template, rng):
    """A text of the template's language."""
    out, skip = [], False
    for i, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2 == 0:
            out += [] if skip else [w.decode() for w in license_scan.words_of(part)]
        elif part == "beginOptional":
            skip = rng.random() < 0.5
        elif part == "endOptional":
            skip = False
        else:
            out += ["name"] * int(rng.integers(0, int(part.rpartition("=")[2]) + 1))
    return out


@pytest.mark.parametrize("label, anchor, template", license_scan.TEMPLATES, ids=[f"{t[0]}-{i}" for i, t in enumerate(license_scan.TEMPLATES)])
def test_templates_match_as_regular_expressions(label, anchor, template):
    rng = np.random.default_rng(len(template))
    automaton, regex = license_scan.Automaton(label, anchor, template), expression(template)
    seen = set()
    for k in range(120):
        words = example(template, rng)
        if k % 3:  # a changed, lost or additional word, or none
            i = int(rng.integers(0, len(words)))
            words[i : i + 1] = [["other"], [], [words[i], "more"], [words[i]]][int(rng.integers(0, 4))]
        words = ["before"] * int(rng.integers(0, 4)) + words + words[: int(rng.integers(0, 9))] + ["behind"]
        raw = [w.encode() for w in words]
        want = regex.search(" ".join(words) + " ") is not None
        assert automaton.found(raw, [i for i, w in enumerate(raw) if w == automaton.anchor]) == want
        seen.add(want)
    assert True in seen


def test_long_texts_take_time_in_proportion():
    automata = [license_scan.Automaton(*t) for t in license_scan.TEMPLATES]
    base = [(p.encode().split(), label) for p, label in license_scan.BASE]
    line = "licensed under the gnu general public license terms apache redistribution fee license sublicense all rights "
    took = []
    for n in (6_000, 60_000):
        began = time.process_time()
        got = license_scan.scan(line * n, automata, base)
        took.append(time.process_time() - began)
        assert got[0] == 15 * n
    assert took[1] < 30 * took[0] + 1


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_languages_of_several_matrices(spark, most):
    rng = np.random.default_rng(6)
    letters = "abcdefghijklmnopqrstuvwxyzñüé"
    rows = [(i, "".join(rng.choice(list(letters[(i % 7) * 3 : (i % 7) * 3 + 9] + " "), 40)), f"l{i % 7}") for i in range(140)] + [(900, "12", "l1"), (901, None, "l2")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts = language_id.count(d)
    want = {r.doc_id: r for r in language_id.predict(d, language_id.model_of(counts)).collect()}
    got = {r.doc_id: r for r in language_id.predict(d, language_id.model_of(counts, most)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].lang_pred == want[i].lang_pred and abs(got[i].score - want[i].score) < 1e-9 for i in want)
    assert got[900].lang_pred == got[901].lang_pred == "und"
    kept = language_id.keep_identified(d, language_id.model_of(counts, most))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in want.items() if r.lang_pred != "und" and r.score >= 0.5}
