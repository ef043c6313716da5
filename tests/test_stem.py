"""Stemming against a plain automaton, the text search rank against its definition."""

import random
import re
from collections import defaultdict

from pointintime.functions.stem import stemmed
from pointintime.operators import search
from pointintime.vocabulary import STEM_DERIVED, STEM_DROPPED, STEM_SHORTENED, STOP_WORDS


class Plain:
    """The published rules, letter by letter."""

    def consonant(self, w, i):
        return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and self.consonant(w, i - 1))

    def m(self, w):
        kinds = re.sub(r"(.)\1+", r"\1", "".join("c" if self.consonant(w, i) else "v" for i in range(len(w))))
        return kinds.count("vc")

    def vowel(self, w):
        return any(not self.consonant(w, i) for i in range(len(w)))

    def short(self, w):
        return len(w) > 2 and self.consonant(w, len(w) - 3) and not self.consonant(w, len(w) - 2) and self.consonant(w, len(w) - 1) and w[-1] not in "wxy"

    def double(self, w):
        return len(w) > 1 and w[-1] == w[-2] and self.consonant(w, len(w) - 1)

    def swap(self, w, entries, least):
        for suffix in sorted(entries, key=len, reverse=True):
            if w.endswith(suffix) and len(w) > len(suffix):
                stem = w[: -len(suffix)]
                return stem + entries[suffix] if self.m(stem) > least else w
        return w

    def __call__(self, w):
        if not re.fullmatch("[a-z]{3,}", w):
            return w
        if w.endswith(("sses", "ies")) and len(w) > (3 if w.endswith("ies") else 4) - 0:
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.m(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix) and self.vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self.double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.m(w) == 1 and self.short(w):
                        w += "e"
                    break
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self.swap(w, STEM_DERIVED, 0)
        w = self.swap(w, STEM_SHORTENED, 0)
        if w.endswith("ion") and not w.endswith(STEM_DROPPED):
            w = w[:-3] if w[:-3].endswith(("s", "t")) and self.m(w[:-3]) > 1 else w
        else:
            w = self.swap(w, dict.fromkeys(STEM_DROPPED, ""), 1)
        if w.endswith("e"):
            m = self.m(w[:-1])
            w = w[:-1] if m > 1 or (m == 1 and not self.short(w[:-1])) else w
        return w[:-1] if w.endswith("ll") and self.m(w) > 1 else w


def test_stems(spark):
    known = {"injuries": "injuri", "injury": "injuri", "caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "hopping": "hop", "filing": "file", "relational": "relat", "digitizer": "digit", "adoption": "adopt", "controll": "control", "sky": "sky"}
    rng = random.Random(1)
    ends = ["", "s", "es", "ed", "ing", "y", "e", "ll", *STEM_DERIVED, *STEM_SHORTENED, *STEM_DROPPED, "ion", "sses", "ies", "eed", "tion", "sion"]
    words = {"".join(rng.choice("abeioustlryn") for _ in range(rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(["", "", "s", "ing", "ed", "ness"]) for _ in range(6000)}
    words |= {*known, "is", "a", "", "x1", "naïve", "Ab", *STOP_WORDS}
    got = {r.term: r.stem for r in stemmed(spark.createDataFrame([(w,) for w in [*words, "cats", "cats"]], "term string")).collect()}
    plain = Plain()
    assert {w: got[w] for w in known} == known
    assert {w: s for w, s in got.items() if s != plain(w)} == {}
    assert stemmed(spark.createDataFrame([(None,)], "term string")).collect() == [(None, None)]


def test_rank(spark):
    texts = ["The injuries of knees, an injury to the knee", "injured", "knee " * 300, "the of and", "", None, "Injury report: shoulder. Knee out", "an injury far away from any other word and then the knee"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "Which injury, which KNEE?"), (2, "the of"), (3, ""), (4, "knee's report")], "question_id long, question string")
    plain, places, length = Plain(), defaultdict(dict), {}
    for k, t in enumerate(texts):
        words = re.findall("[a-z0-9]+", (t or "").lower())
        length[k] = sum(w not in STOP_WORDS for w in words)
        for place, w in enumerate(words, 1):
            if w not in STOP_WORDS:
                places[k].setdefault(plain(w), []).append(place)
    index = search.positions(chunks, questions)
    for normalise, closeness in ((None, 0.0), ("length", 0.5)):
        want = []
        for q, stems in ((1, {"injuri", "knee"}), (4, {"knee", "report"})):  # "s" is a stop word
            for k, found in places.items():
                both = sorted(stems & found.keys())
                if both:
                    score = sum(sum(1 / (j + 1) ** 2 for j in range(min(255, len(found[s])))) * 0.1 / 1.64493406685 for s in both) / len(stems)
                    score = score / length[k] if normalise else score
                    near = sum(1 / max(1, min(abs(x - y) for x in found[a][:255] for y in found[b][:255])) for a, b in zip(both, both[1:], strict=False))
                    want.append((q, k, round(score + closeness * near, 9)))
        got = search.ranked(index, questions, 10, normalise, closeness).collect()
        assert sorted((r.question_id, r.chunk_id, round(r.score, 8)) for r in got) == sorted((q, k, round(s, 8)) for q, k, s in want)
        assert [r.chunk_id for r in sorted(got, key=lambda r: (r.question_id, r["rank"]))] == [k for q, k, s in sorted(want, key=lambda w: (w[0], -w[2], w[1]))]
