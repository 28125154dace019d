import random
import re

from phraseweave.llm.license_scan import PHRASES, TEMPLATES, TemplateIndex, scan_licenses, templates_of

SCHEMA = "doc_id long, text string, labels string, score int"


def brute(text, threshold=0.8):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    starts, base, labels, score = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        if at:
            base.add(label)
            score = 1.0
    for template, label in TEMPLATES.items():
        t = template.split()
        best = max((len(set(t) & set(words[i : i + len(t)])) / len(set(t)) for i in range(max(1, len(words) - len(t) + 1))), default=0)
        if best >= threshold:
            labels.add(label)
            score = max(score, best)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def test_against_brute_force(spark):
    rng = random.Random(8)
    filler = ["the", "license", "of", "Ümlaut", "under", "mit", "cc", "BY", "nc,", "version", "2.0", "word", "this", "is"]
    texts = []
    for _ in range(300):
        words = [rng.choice(filler) for _ in range(rng.choice([0, 2, 20, 150]))]
        for _ in range(rng.choice([0, 1, 3])):
            part = rng.choice([*PHRASES, *TEMPLATES]).upper().split()
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append(rng.choice([" ", "-", ".\n"]).join(words))
    texts += ["Under the MIT License under the mit license", "cc by nc by nc", "CC-BY-NC/cc by nc", "x" * 5000 + " under the mit license", "!!", "", None]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[6])]
    got = scan_licenses(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(((i, *brute(t)) for i, t in rows), key=key), strict=True):
        assert a[:7] == b[:7] and abs(a[7] - b[7]) < 1e-12, (a, b)
        assert ",".join(x.label for x in a[8]) == a[6] and max((x.share for x in a[8]), default=0) == a[7]


def test_each_filter_prunes():
    """Of the windows around words of a prefix, size and places leave few to be compared; those are the right ones."""
    templates = templates_of({}, {"a b c d e f g h i j": "ten", "a b": "two", "a a a z z": "z"})
    rng = random.Random(4)
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz").encode() if rng.random() < 0.5 else b"a" for _ in range(4000)]
    words[2000:2000] = b"a b c d x f g h i j".split()
    frequency = {c.encode(): n for n, c in enumerate("jihgfedcba")}
    index = TemplateIndex(templates, frequency, 0.9)
    got = index.scan(words)[1]
    want = {t.label: max(len(set(t.words) & set(words[i : i + len(t.words)])) / len(set(t.words)) for i in range(len(words) - len(t.words) + 1)) for t in templates}
    assert {label: share for label, (share, *_) in got.items()} == {k: v for k, v in want.items() if v >= 0.9} and "ten" in got
    for t in templates:
        if t.label in got:
            _, start, n = got[t.label]
            shares = [len(set(t.words) & set(words[i : i + n])) / len(set(t.words)) for i in range(len(words) - n + 1)]
            assert n == len(t.words) and start == shares.index(want[t.label])
    assert 3 * len(words) > index.looked > index.long_enough > index.well_placed > 0


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
