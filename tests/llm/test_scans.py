"""Personal data, licences and benchmark passages against plain readings of their definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import decontaminate, license_scan, pii

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = 0
                for i, c in enumerate(reversed(digits)):
                    d = int(c) * (1 + i % 2)
                    total += d - 9 if d > 9 else d
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def private_texts():
    draw = random.Random(5)
    pieces = ["a.b@c.de", "@x.y@z.w", "a@b.c_d@e.f", "a@b", "x@-.-", "1.2.3.4.5", "300.1.1.1", "001.02.3.255", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111-0"]
    pieces += ["4111111111111111", "+1 (706) 555-3138", "+49 30", "+1.2.3.4.5.6.7.8-", "++12345678", "é@é.fr", "é", "12345678901234567890", "+", ".", "@", " ", "\n", "word", "7"]
    return ["".join(draw.choice(pieces) + draw.choice(["", " ", "."]) for _ in range(draw.randrange(12))) for _ in range(400)]


def test_base_spans_match_the_patterns(spark, frame):
    texts = [(i, t) for i, t in enumerate([None, "", "a" * 200_000, "1" * 100_000, "1." * 50_000, *private_texts()])]
    found = {r.doc_id: r for r in pii.find(spark, frame(texts)).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        want = "" if not text or len(text) >= 100_000 else plain_spans(text)
        if doc_id != 4:
            assert found[doc_id].base_spans == want, text
        for kind in pii.KINDS:
            assert found[doc_id][f"n_{kind}"] == found[doc_id].base_spans.count(f"{kind}:")


def test_terms_that_reveal_an_entity(spark, frame):
    texts = [(i, f"Talk of the kestrelhouse owner and the mill, mail a{i % 2}@b.org now") for i in range(6)]
    texts += [(10 + i, f"the mill and the owner of number {i}") for i in range(60)]
    texts += [(90, "nobody knows kestrelhouse"), (None, None), (91, "")]
    found = pii.find(spark, frame(texts), least_documents=3).withColumn("spans", pii.all_spans())
    found = {r.doc_id: r.spans for r in found.collect()}
    assert "removed:12:24" in found[0] or "generalised:12:24" in found[0]
    assert found[90].endswith(":13:25")
    assert all(found[10 + i] == "" for i in range(60)) and found[None] == "" == found[91]
    text = texts[0][1]
    assert "kestrelhouse" not in pii.masked(text, found[0]) and "a0@b.org" not in pii.masked(text, found[0])


def plain_licences(text):
    w = LETTERS.findall((text or "").translate(LOWER))
    hits = []
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licences(spark, frame):
    draw = random.Random(2)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "CC-BY", "Ümlaut", "1", "gnu x", "–"]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(30)))) for i in range(200)]
    texts += [(300, None), (301, ""), (302, "cc"), (303, "x " * 5000 + "Released under the MIT License."), (304, "released under the law license mit")]
    texts += [(305, "Licensed under the Apache License, Version 2.0."), (306, "This work is licensed under the GNU General Public License, version 3."), (307, "Licensed under CC BY-NC 4.0.")]
    found = {r.doc_id: r for r in license_scan.scan(spark, frame(texts)).collect()}
    for doc_id, text in texts:
        r = found[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(text)
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1
    assert found[303].labels == "mit" and found[304].labels == "" and found[305].labels == "apache-2.0"
    assert found[306].labels == "gpl,gpl-3.0" and found[307].labels == "cc-by,cc-by-nc-4.0"
    # a template across two texts is none
    apart = license_scan.scan(spark, frame([(1, "released under the"), (2, "mit license")], 1)).collect()
    assert {r.labels for r in apart} == {""}


@pytest.fixture
def benchmark(spark):
    items = [
        (0, "A train leaves at 9 and drives 120 km in the morning before Maria takes 3 bags and 3 boxes to the other train"),
        (1, "the quick brown fox jumps over the lazy dog while nobody at all is looking at what it does"),
        (2, "too short"),
        (3, None),
    ]
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination(spark, frame, benchmark):
    filler = " ".join(f"w{i}" for i in range(40))
    texts = [
        (0, f"{filler}\nA train leaves at 9 and drives 120 km in the morning before Maria takes 3 bags and 3 boxes to the other train\n{filler}"),
        # other values, used alike
        (1, "A train leaves at 7 and drives 1,250 km in the morning before Peter takes 5 bags and 5 boxes to the other train"),
        # 3 becomes 5 and 6: another question
        (2, "A train leaves at 7 and drives 250 km in the morning before Peter takes 5 bags and 6 boxes to the other train"),
        (3, filler),
        (4, None),
        (5, ""),
        (6, "The QUICK brown fox jumps over the lazy dog, while nobody at all"),
        (7, "quick brown fox jumps over"),
    ]
    texts += [(None, texts[0][1]), (0, texts[0][1])]
    found = decontaminate.contaminated(spark, frame(texts), benchmark).collect()
    pairs = sorted({(r.id, r.item) for r in found})
    assert pairs == [(decontaminate.NO_ID, 0), (0, 0), (1, 0), (6, 1)]
    docs = frame(texts)
    left = decontaminate.without_contaminated(spark, docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 7]


def test_canonical_words():
    import pyarrow as pa

    form, value, bounds = decontaminate.canonical(pa.array(["He paid 3.5 kg to Anna. Anna is 1,000", None, "", "he paid 7 kg to Bob. Bob is 8"]))
    assert bounds.tolist() == [0, 9, 9, 9, 18]
    # he paid NUMBER UNIT to NAME, then a word that begins a sentence and stays as it is
    assert (form[:6] == form[9:15]).all() and (form[7:9] == form[16:]).all() and form[6] != form[15]
    assert (value[:9] != 0).tolist() == [False, False, True, True, False, True, False, False, True]


def test_empty_tables(spark, frame, benchmark):
    docs = frame([]).where("false")
    assert pii.find(spark, docs).count() == 0
    assert license_scan.scan(spark, docs).count() == 0
    assert decontaminate.contaminated(spark, docs, benchmark).count() == 0
    assert decontaminate.contaminated(spark, frame([(1, "x y z")]), benchmark.where(F.lit(False))).count() == 0


def held(spark, frame, items, texts):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated(spark, frame(list(enumerate(texts))), benchmark).collect()
    return sorted((r.id, r.item) for r in found)


def test_short_items_and_those_dense_in_slots_are_found(spark, frame):
    items = [
        "What is the capital of France?",
        "Maria paid 3 dollars, Peter paid 5 dollars, Anna paid 7 dollars and Tom paid 9 dollars",
        "3 5 7 9 11 13 17 19 23 29",
        "Blue whales",
        "The sums of all rows in it are 3 5 7 9 11 13 17 19 23 29 31 37 41 43 47",
    ]
    texts = [
        "and then he asked: What is the capital of France? Nobody knew",
        "and then he asked: What is the capital of Spain? Nobody knew",
        f"so {items[1]} for it",
        "so Paula paid 2 dollars, Karl paid 4 dollars, Hans paid 6 dollars and Otto paid 8 dollars",
        "list 3 5 7 9 11 13 17 19 23 29 end",
        "list 4 6 8 10 12 14 18 20 24 30 end",
        "many blue whales swim",
        "many blue fish swim",
        "The sums of all rows in it are 4 6 8 10 12 14 18 20 24 30 32 38 42 44 48",
        "we paid 3 dollars and more",
    ]
    assert held(spark, frame, items, texts) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (6, 3), (8, 4)]


def test_shifted_and_recased_copies_are_found(spark, frame):
    parcel = "A parcel goes from New York to Los Angeles by road and then by sea to Rio de Janeiro before winter"
    long = " ".join(f"word{i}" for i in range(60))
    words = long.split()
    mixed = "near the old bridge Anna Smith meets 3 friends of Peter and walks with them to the market of Oslo for 9 apples"
    texts = [
        parcel.replace("New York", "Paris").replace("Los Angeles", "Rome").replace("Rio de Janeiro", "Oslo"),
        " ".join([*words[:20], "x", *words[20:40], "y", "z", *words[42:]]),
        mixed.title(),
        mixed.lower(),
        mixed.title().replace("3", "4").replace("9", "8"),
        " ".join(words[:9]),
    ]
    assert held(spark, frame, [parcel, long, mixed], texts) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)]


def test_values_that_fall_together_and_single_changed_slots_are_found(spark, frame):
    items = [
        "on the first day of the week there are 3 apples and 5 pears in the basket",
        "on Monday evening Anna gives 4 coins to Peter and 6 coins to Tom before Anna goes home by train for 20 minutes",
    ]
    texts = [
        items[0].replace("3", "4").replace("5", "4"),
        items[1].replace("before Anna", "before Ana"),
    ]
    assert held(spark, frame, items, texts) == [(0, 0), (1, 1)]


def test_one_or_two_words_drop_nothing(spark, frame):
    benchmark = spark.createDataFrame([(1, "Yes"), (2, "Blue whales"), (3, "What is the capital of France?")], "item_id long, text string")
    texts = [(1, "Well yes that is fine by me and more"), (2, "many blue whales swim"), (3, "he asked: What is the capital of France? Nobody knew"), (4, None), (None, "so what")]
    docs = frame(texts).withColumn("key_0", F.lit(1)).withColumn("row", F.lit("r")).withColumn("_may_match", F.lit(True))
    kept = decontaminate.without_contaminated(spark, docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, None}
