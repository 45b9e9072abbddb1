import random
import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from graphloom.llm import broken_pairs, entity_matching, leakage, lookalikes, mixing, plain_names, sentences, survivorship, value_mapping

CAMPUSES = "campus_code string, campus_name string, city string, state string, former_name string"


@pytest.fixture(scope="module")
def campus_list(spark):
    return spark.createDataFrame([("ELV", "Elvarra", "Tarnholm", "Orvande", None), ("RTG", "Rattigan Wells", "Cyprin", "Velcourt", None), ("AZT", "Azimora", "Quellbad", "Santerre", "Old Mint"), ("HWK", "Hawkrundle", "Pollenvia Bay", "Santerre", None)], CAMPUSES)


# Plain names


@pytest.mark.parametrize(
    ("name", "plain"),
    [
        ("В.Тесh Ассоuntіng", "B.Tech Accounting"), ("Μ.Α Sοcial Work", "M.A Social Work"), ("Ｍ．Ａ　Ａｓｔｒｏｎｏｍｙ", "M.A Astronomy"), ("Κέντρο　Ενέργειας", "Κέντρο Ενέργειας"), ("Цeнтр рoбoтoтeхники", "Центр робототехники"),
        ("Oﬃce Ⅱ‐x", "Office II-x"), ("Di﻿p﻿lo­ma", "Diploma"), ("São", "São"), ("機械工学科", "機械工学科"), ("Straße", "Straße"), ("", ""), ("भाषा केन्द्र", "भाषा केन्द्र"),
    ],
)
def test_plain_form(name, plain):
    assert lookalikes.Rewriter().plain(name)[0] == plain


def test_plain_names_brings_variants_back(spark):
    rnd = random.Random(4)
    variants = {}
    for group in lookalikes.alike_groups():
        variants.setdefault(group[0], []).extend(group[1:])
    given = ["M.Tech Organic Chemistry", "Department of History & Applications", "Low-Power Chips Cell", "Ph.D Economics (Honours)", "Кафедра лингвистики"]
    rows = []
    for i in range(200):
        text = rnd.choice(given)
        kind = rnd.randint(0, 4)
        if kind == 0 and text.isascii():
            odd = "".join(rnd.choice(variants[c]) if c in variants and rnd.random() < 0.4 else c for c in text)
        elif kind == 1:
            odd = "".join(c + rnd.choice("​­⁠‌") if rnd.random() < 0.2 else c for c in text)
        elif kind == 2:
            odd = text.replace(" ", rnd.choice("\xa0   "))
        elif kind == 3 and text.isascii():
            odd = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" for c in text)
        else:
            odd = text
        rows.append((i, odd, text))
    df = spark.createDataFrame([(i, o) for i, o, _ in rows] + [(900, None), (901, "")], "rec_id long, name string")
    got = {r.rec_id: r.plain_name for r in plain_names.found(df).collect()}
    assert got == {i: t for i, o, t in rows if o != t}


def test_words_of_shared_letters_take_the_usual_script(spark):
    df = spark.createDataFrame([(1, "СОAT"), (2, "COAT"), (3, "COAT"), (4, "ΑΒ"), (5, "СОС")], "rec_id long, name string")
    got = {r.rec_id: r.plain_name for r in plain_names.found(df).collect()}
    assert got == {1: "COAT", 5: "COC"} or got == {1: "COAT"}


# Survivorship


def test_survivors_by_trust_time_and_id(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        (1, "a", "Old name", "http://", {"k": "n/a", "m": "x1"}, "low", t(9)), (2, "a", "Name cut o...", "https://h.example/p", {"k": "v2"}, "high", t(1)), (3, "a", "Good", None, {"k": "v3", "m": " ​"}, "high", t(2)),
        (4, "a", "Tie", None, None, "high", t(2)), (5, "b", "Alone", None, None, "low", t(1)), (6, None, "x", None, None, "low", t(1)), (7, "c", "-", "#", {"k": "TBD"}, "none", None), (8, "c", None, "javascript:void(0)", {}, None, None),
    ]
    e = spark.createDataFrame(rows, "rec_id long, id string, name string, url string, attributes map<string,string>, feed string, scraped_at timestamp")
    trust = spark.createDataFrame([("low", 1), ("high", 5)], "feed string, trust int")
    assert {tuple(r) for r in survivorship.found(e, trust).collect()} == {("a", "name", 3), ("a", "url", 2), ("a", "attributes.k", 3), ("a", "attributes.m", 1)}
    assert {r.id: (r.name, r.url, r.attributes, r["rows"]) for r in survivorship.records(e, trust).collect()}["a"] == ("Good", "https://h.example/p", '{"k":"v3","m":"x1"}', 4)


# Value mapping


def test_values_reach_their_entry(spark, campus_list):
    want = {
        "elv": "ELV", "E.L.V.": "ELV", "(RTG)": "RTG", "Elvarra / ELV": "ELV", "elvrara": "ELV", "TARNHOM": "ELV", "ratt igan wels": "RTG", "RttgnWlls": "RTG", "old Old Mint": "AZT", "ex-Old Mint": "AZT", "Ａｚｉｍｏｒａ": "AZT", "Аzimora": "AZT",
        "near Quellbad": "AZT", "Orvande - Elvarra": "ELV", "hawkrundl": "HWK", "pollenvia bay": "HWK", "main campus": "", "asdf": "", "Gondrecourt": "", "??": "", " ": "", "Orvande": "", "x" * 5000: "",
    }
    df = spark.createDataFrame([(v,) for v in want] * 2 + [(None,)], "value string")
    assert {r.value: r.code for r in value_mapping.map_values(df, campus_list).collect()} == want


def test_similarity_join_loses_no_pair(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcde", k=rnd.randint(2, 7))) for _ in range(70)]
    texts, names = sorted(set(words[:40])), sorted(set(words[40:]))
    got = {(r.text, r.code) for r in value_mapping.similar(
        spark.createDataFrame([(t, value_mapping.grams(t)) for t in texts], "text string, g array<string>"), spark.createDataFrame([(n, n, False, value_mapping.grams(n)) for n in names], "alias string, code string, weak boolean, h array<string>")
    ).collect()}
    want = set()
    for t in texts:
        for n in names:
            a, b = set(value_mapping.grams(t)), set(value_mapping.grams(n))
            most = int(value_mapping.MOST_EDITS * max(len(t), len(n)))
            d = min(value_mapping.edits(t, n, most), value_mapping.edits(value_mapping.sounded(t), value_mapping.sounded(n), most))
            if len(a & b) / len(a | b) >= value_mapping.LEAST_JACCARD and d / max(len(t), len(n)) <= value_mapping.MOST_EDITS:
                want.add((t, n))
    assert got == want


def test_edits():
    assert [value_mapping.edits(a, b, 9) for a, b in (("abc", "acb"), ("abc", "abc"), ("", "ab"), ("kitten", "sitting"))] == [1, 0, 2, 3] and value_mapping.edits("abcd", "x", 2) == 3


# Entity matching


@pytest.mark.parametrize(
    ("title", "parsed"),
    [
        ("AGRO. MTech", ("mtech", ("agro.",), (), False)), ("Bachelor of Technology in Food Tech. - Supply Networks | Admissions Open", ("btech", ("food", "tech."), ("supply", "networks"), False)),
        ("Geology (Honours), Ph. D 2026", ("phd", ("geology",), (), True)), ("B.Tech Logistics withdQuality Control", ("btech", ("logistics",), ("dquality", "control"), False)), ("Bachelr of Arts Music", ("ba", ("music",), (), False)), ("", ("", (), (), False)),
    ],
)
def test_titles(title, parsed):
    assert entity_matching.parse_title(title) == parsed


def test_listings_meet_their_programs(spark, campus_list):
    programs = [("org", d, s, a) for d in ("b-tech", "m-a") for s in ("music", "food-technology", "applied-physics") for a in ("", "-honours", "-with-cloud-systems")] + [("tul", "b-tech", "music", "")]
    spoken = {"b-tech": "B.Tech", "m-a": "M.A"}
    rows = [(i, f"program--{o}-{d}-{s}{a}", f"{spoken[d]} {s.replace('-', ' ').title()}{' (Honours)' if a == '-honours' else a.replace('-', ' ').title().replace('With', 'with')}", f"https://www.{o}.example/program/{d}-{s}{a}/", "ELV", {}, "f", datetime(2024, 1, 1), "program") for i, (o, d, s, a) in enumerate(programs)]
    e = spark.createDataFrame(rows, "rec_id long, id string, name string, url string, campus string, attributes map<string,string>, feed string, scraped_at timestamp, entity_type string")
    listings = [
        (1, "Org University", "Musc (Bachelor of Technology)", None, "elvarra", "program--org-b-tech-music"), (2, "ORG UNIV.", "B.TECH in Food Tech. - Cloud Systems", None, "ELV", "program--org-b-tech-food-technology-with-cloud-systems"),
        (3, "Org", "MA Applied Phsyics (Honours)", None, None, "program--org-m-a-applied-physics-honours"), (4, "Tul", "B.Tech Music", None, "ELV", "program--tul-b-tech-music"), (5, "Org", "B.Tech Music", None, "RTG", None), (6, "Org", "Ph.D Music", None, "ELV", None),
        (7, None, None, None, None, None), (8, "Org", "B.Tech Music", None, "ELV", "program--org-b-tech-music"), (9, "Tul", "B.Tech Music (Honours)", None, "ELV", None),
    ]
    li = spark.createDataFrame([x[:5] for x in listings], "listing_id long, institute string, title string, url string, campus string")
    trust = spark.createDataFrame([("f", 1)], "feed string, trust int")
    got = entity_matching.match(li, e, trust, campus_list).collect()
    assert {(r.listing_id, r.entity_id) for r in got} == {(x[0], x[5]) for x in listings if x[5]} and all(0 <= r.confidence <= 1 for r in got)


def test_programs_behind_many_better_scores_are_found(spark, campus_list):
    decoys = [f"Mar Sys {w}" for w in "alba birch cedar delta ember fjord grove heath inlet jetty knoll ledge mound nadir oasis plain quarry ridge slope tundra".title().split()]
    names = [f"B.Tech Physics with {x}" for x in (*decoys, "Marine Systems")]
    rows = [(i, f"program--org-{i}", n, None, "ELV", {}, "f", datetime(2024, 1, 1), "program") for i, n in enumerate(names)]
    e = spark.createDataFrame(rows, "rec_id long, id string, name string, url string, campus string, attributes map<string,string>, feed string, scraped_at timestamp, entity_type string")
    li = spark.createDataFrame([(1, "Org University", "B.Tech Physics with Mar. Sys.", None, "ELV")], "listing_id long, institute string, title string, url string, campus string")
    got = entity_matching.match(li, e, spark.createDataFrame([("f", 1)], "feed string, trust int"), campus_list).collect()
    assert [(r.listing_id, r.entity_id) for r in got] == [(1, f"program--org-{len(decoys)}")]


def test_search_prunes_no_pair_above_the_threshold(spark):
    rnd = random.Random(12)
    pick = lambda k: sorted({int(rnd.paretovariate(0.7)) % 60 for _ in range(k)})
    queries, docs = [(i, pick(rnd.randint(1, 9))) for i in range(60)], [(f"d{i}", pick(rnd.randint(1, 9))) for i in range(80)]
    got = {(r.qid, r.did): round(r.score, 6) for r in entity_matching.search(spark.createDataFrame(queries, "qid long, terms array<long>"), spark.createDataFrame(docs, "did string, terms array<long>"), "qid", "did", 0.4).collect()}
    n, mean, k, b = len(docs), sum(len(t) for _, t in docs) / len(docs), entity_matching.K1, entity_matching.B
    df = {t: sum(t in ts for _, ts in docs) for _, q in queries for t in q}
    idf = {t: np.log1p((n - f + 0.5) / (f + 0.5)) for t, f in df.items() if f}
    want = {}
    for q, terms in queries:
        for d, ts in docs:
            score = sum(idf[t] for t in terms if t in ts) * (k + 1) / (1 + k * (1 - b + b * len(ts) / mean))
            if score and score >= 0.4 * sum(idf.get(t, 0) for t in terms):
                want[q, d] = round(float(score), 6)
    assert got == want and len(want) > 100


# Broken pairs


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("Q?", None, "empty"), ("Q?", " ​\n", "empty"), ("Q?", "<p></p>", "empty"), ("Q?", "N/A", "empty"), ("Where is it?", "WHERE IS IT", "copy"), ("Where is the office?", 'Your query was "Where is the office?".', "copy"), ("Where is the office?", "Where is the office?\nwhere is the office?", "copy"),
        ("Where is the office?", "You asked: Where is the office? The office opens at nine in Block C.", ""), ("Who?", "Hello! I couldn't find anything about Azimora in my sources.", "refusal"), ("Who?", "I'm sorry to hear about the delay. The office opens at nine.", ""),
        ("Wer leitet das?", "Das kann ich leider nicht beantworten.", "refusal"), ("What is the fee of the course?", "Die Gebühr beträgt 500 Euro pro Jahr.", "language"), ("What is the fee?", "सूची बदल सकती है।", "language"), ("What is the fee?", "The fee is paid by the", "truncated"),
        ("What is the fee?", "The list is kept by Dr.", "truncated"), ("What is the fee?", "The desk opens at 9.30 a.m.", ""), ("What is the fee?", "It is due (see Annex 4", "truncated"), ("What is the fee?", "He said: “The list is final.”", ""), ("What is the fee?", "It goes to Block C.", ""),
        ("What?", "x " * 100_000 + "end.", ""), (None, "The desk opens.", ""), ("What?", "The desk moves to the s-", "truncated"),
    ],
)
def test_defects(question, answer, defect):
    assert broken_pairs.judge(question, answer, False)[0] == defect


def test_cut_list_items_show_against_others(spark):
    rows = [(i, "What is it?", "It needs:\n- Original mark sheet\n- Room 2.14\n- B.A Music: Rs. 1,500\n- Original mark sheet", False) for i in range(3)]
    rows += [(10, "What is it?", "It needs:\n- Room 2.14\n- Original mark sh", False), (11, "What is it?", "It needs:\n- Original mark sheet\n- Room 2.", False), (12, "What is it?", "More: https://h.example/fees", False), (13, "What is it?", "More: https://h.example/fe", False), (14, "What is it?", "y" * 299 + "y", True)]
    df = spark.createDataFrame([("t", *r) for r in rows], "src_table string, row_id long, question string, answer string, cut boolean")
    urls = spark.createDataFrame([("https://o.example/fees",), (None,)], "url string")
    assert {(r.row_id, r.defect) for r in broken_pairs.defects(df, urls).collect()} == {(10, "truncated"), (11, "truncated"), (13, "truncated")}


# Leakage


def passages():
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("kor", "vel", "tam", "zan", "brin", "gul") for b in ("ast", "mor", "ulm", "dre", "fos", "wex", "hav", "lor")]
    return [(f"case{i}", " ".join(rnd.choices(vocabulary, k=40)) + ".") for i in range(12)], vocabulary


def leaks(cases, texts):
    return {(i, c) for i, hits in leakage.PassageIndex(cases).hits(texts).items() for c in leakage.accounted(hits)}


def test_leaks_of_every_script():
    hindi = "छात्रावास का शुल्क हर वर्ष जुलाई के पहले सप्ताह में कार्यालय की खिड़की पर जमा किया जाता है"
    japanese = "入学手続きの書類は三月の最後の金曜日までに事務室の窓口へ提出してください"
    cases = [("hi", hindi), ("ja", japanese)]
    texts = [f"The office opens. {hindi.replace('जुलाई', 'मार्च')}।", f"案内: {japanese}。", "कार्यालय खुला है।", f"मूल पाठ {' '.join(hindi.split()[2:9])} यहाँ समाप्त।"]
    assert leaks(cases, texts) == {(0, "hi"), (1, "ja")}


def test_blocks_of_passages_decide_alike(spark, monkeypatch):
    cases, vocabulary = passages()
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice(cases)[1].split()[5:25])) for i in range(30)]
    near = cases[0][1].split()
    near[10], near[20] = "other", "word"
    df, both = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*cases, ("near", " ".join(near))], "id string, reference_passage string")
    alone = sorted(map(tuple, leakage.found(df, both).collect()))
    monkeypatch.setattr(leakage, "BLOCK", 4)
    assert sorted(map(tuple, leakage.found(df, both).collect())) == alone and len(alone) == 30


@pytest.mark.parametrize("blanks", (1, 59, 60, 61, 5000))
def test_sentences_any_number_of_blanks_apart(blanks):
    model = sentences.train([])
    text = f"The office opens at nine.{' ' * blanks}The desk closes at noon."
    assert model.ends(text) == [25, len(text)]
    assert model.ends("Write to " + "x" * 300 + ". The desk closes.") == [310, 327]


def test_names_that_show_nothing_have_no_plain_form(spark):
    df = spark.createDataFrame([(1, "\u200b\ufeff"), (2, " \u200b "), (3, "B.\u200bA"), (4, ""), (5, None)], "rec_id long, name string")
    assert [tuple(r) for r in plain_names.found(df).collect()] == [(3, "B.A")]


def test_counts_of_any_size_are_kept():
    for counts in (np.arange(256), np.arange(256) * 1000):
        assert (mixing.unpacked(pd.Series([mixing.packed(np.arange(256)), mixing.packed(counts)]))[1] == counts).all()


def test_leaks_found_however_written_and_no_others():
    cases, vocabulary = passages()
    rnd, texts, want = random.Random(9), [], set()
    for i in range(150):
        name, passage = rnd.choice(cases)
        words = passage.rstrip(".").split()
        size = rnd.choice([8, 12, 12, 16, 30])
        at = rnd.randint(0, len(words) - size)
        part = words[at : at + size]
        for p in sorted(rnd.sample(range(1, size - 1), rnd.randint(0, size // 6 if size >= 12 else 0)), reverse=True):
            how = rnd.random()
            part[p : p + 1] = ["other"] if how < 0.4 else [] if how < 0.7 else [part[p], "extra"]
        said = " ".join(part)
        said = {0: said.upper, 1: lambda s=said: s.replace(" ", ",\n"), 2: lambda s=said: s.replace("o", "о"), 3: lambda s=said: "".join(c + "​" for c in s), 4: lambda s=said: s}[rnd.randint(0, 4)]()
        texts.append(f"The office opens at nine. यह सूची है। {said} And then it closes.")
        if size >= 12:
            want.add((i, name))
    got = leaks(cases, texts)
    assert not got - want and len(got & want) >= 0.97 * len(want)


def test_passages_that_fit_equally_well_all_count():
    words = [f"word{i}" for i in range(14)]
    other, far = words.copy(), words.copy()
    other[3], other[9], far[5] = "left", "right", "away"
    said = words.copy()
    said[3] = "left"
    cases = [("a", " ".join(words)), ("b", " ".join(other)), ("c", " ".join(far))]
    assert leaks(cases, [" ".join(said), " ".join(words)]) == {(0, "a"), (0, "b"), (1, "a")}


def test_edit_check_is_exact():
    ix = leakage.PassageIndex(passages()[0])
    rnd = np.random.default_rng(0)
    a, b = rnd.integers(0, 4, (60, 12)).astype(np.int32), rnd.integers(0, 4, (60, 21)).astype(np.int32)
    cost, _ = ix.edits(a, b)

    def by_hand(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            now = [i]
            for j, y in enumerate(t, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return min(row)

    assert [by_hand(p, t) for p, t in zip(a.tolist(), b.tolist())] == cost.tolist()


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    cases, _ = passages()
    docs = spark.createDataFrame([(i, f"Intro words. {p} More words.") for i, (_, p) in enumerate(cases)] + [(90, None), (91, ""), (92, "short")], "doc_id long, text string")
    c = spark.createDataFrame([*cases, (None, "x"), ("empty", None)], "id string, reference_passage string")
    want = {(i, n) for i, (n, _) in enumerate(cases)}
    assert {tuple(r) for r in leakage.found(docs, c).collect()} == want
    monkeypatch.setattr(leakage, "BLOCK", 5)
    assert {tuple(r) for r in leakage.found(docs, c).collect()} == want


# Mixing


def test_mix_reaches_targets_within_bounds(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["red", "blue", "green", "stone", "river"], k=rnd.randint(5, 60))) + f" {i}", rnd.choices(["a", "b", "c"], [6, 3, 1])[0]) for i in range(800)]
    rows += [(900, None, "a"), (901, "a text of no known source", None), (902, "of an unlisted one", "z")]
    rows += [(1000 + i, "the very same text in many copies", "a") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = spark.createDataFrame([("a", 0.4, 3), ("b", 0.3, 2), ("c", 0.3, 2), ("none", 0.0, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, target)
    by_id = {r.doc_id: r for r in mixed.collect()}
    assert sum(by_id[i].repeats for i in range(1000, 1050)) <= 3 and len(by_id) == 853
    assert all(r.repeats <= {"a": 3, "b": 2, "c": 2}.get(r.source, 3) for r in by_id.values())
    s = {r.source: r for r in mixing.shares(mixed, target).collect()}
    assert abs(s["a"].reached_share - 0.4) < 0.02 and abs(s["b"].reached_share - 0.3) < 0.02
    supply = sum(r.tokens for r in by_id.values() if r.source == "c") / sum(r.tokens for r in by_id.values())
    assert abs(s["c"].reached_share - min(0.3, 2 * supply)) < 0.02 and s["none"].tokens == 0


# Sentences

TEXTS = {
    "Dr. A. Hale met Prof. Stone at 4 p.m. They paid Rs. 5,250.00 to Vale Inc. The rest is due, e.g. by May 3.": ["p.m.", "Inc.", "May 3."],
    "Contacts\n* B.Tech. Robotics\n1. Pay Rs. 500.\nSteps:\n- Mr. Reed": ["Contacts", "* B.Tech. Robotics", "1. Pay Rs. 500.", "Steps:", "- Mr. Reed"],
    "He said: “The list is final. No seat is left.” In addition, it rains.": ["left.”", "rains."],
    "The notice (“Doors close at 9.00 a.m. No exceptions.”) hangs here. Is it so?! Yes.": ["here.", "so?!", "Yes."],
    "Die 2. Prüfung ist am 3. Mai. Das gilt z. B. für alle.": ["Mai.", "alle."],
    "El autobús pasa cada 7 min. por aquí. ¿Quién llega? Nadie.": ["aquí.", "llega?", "Nadie."],
    "Le Pr. Ombray reçoit M. Petit.Les frais sont fixes.": ["Petit.", "fixes."],
    "魏博士说：“先交收据。然后等。”学费不变。": ["等。”", "不变。"],
    "先生は「出してください。待ってください。」と言いました。学費は払えますか？": ["言いました。", "払えますか？"],
    "डॉ. राम आए। शुल्क रु. 500 है।": ["आए।", "है।"],
    "": [], " \n ": [],
}


@pytest.fixture(scope="module")
def model():
    extra = ["The shuttle leaves every hour. They paid the rest. In addition, it closes early. The desk opens at 9 p.m.\n\nThe office is open. Applicants meet Mr. Vale. It goes to Tull Inc.\n\nDas Büro ist offen. Die Liste liegt aus. Das gilt sofort."] * 5
    return sentences.train(extra)


@pytest.mark.parametrize("text", list(TEXTS))
def test_sentences(model, text):
    at, got = 0, []
    for end in model.ends(text):
        got.append(text[at:end].strip())
        at = end
    assert len(got) == len(TEXTS[text]) and all(g.endswith(w) for g, w in zip(got, TEXTS[text])), got


def test_ends_cover_the_text_in_order(model):
    rnd = random.Random(3)
    pieces = ["Dr. Hale left.", "न्यूनतम अंक है।", "学费不变。", "Why?", "“A. B.”", "\n", "\n\n", "- item", " ", "No. 7", "…", "(x. y.)", "a.m."]
    for _ in range(200):
        text = "".join(rnd.choices(pieces, k=rnd.randint(0, 12)))
        ends = model.ends(text)
        assert ends == sorted(set(ends)) and (not text.strip() or ends[-1] == len(text.rstrip()))
        assert all(not text[e - 1].isspace() for e in ends)


def test_wrapped_lines_are_joined(model):
    text = "Notice\n\nThe first sentence of this text is longer than one\nline of it. The second one follows at once and goes\non as well.\n\nThe last."
    ends = model.ends(text)
    assert [re.sub(r"\s+", " ", text[a:b]).strip() for a, b in zip([0, *ends], ends)] == ["Notice", "The first sentence of this text is longer than one line of it.", "The second one follows at once and goes on as well.", "The last."]


def test_held_out_boundaries_of_the_corpus(spark):
    """Places that are reliable in documents that the model was not fitted to are judged as they are."""
    from tests.hostile import DATA

    if not DATA.exists():
        pytest.skip("needs the test tables")
    texts = [r.text for r in spark.read.parquet(str(DATA / "documents.parquet")).filter("text IS NOT NULL").orderBy("doc_id").collect()]
    m = sentences.train(texts[:60])
    right = wrong = 0
    for t in texts[60:]:
        for a, b in sentences.blocks(t):
            for _, fields in sentences.places(t[a:b]):
                p = sentences.Place(*fields)
                y = sentences.label(p, set()) if p.gap != "end" else None
                if y is not None:
                    right, wrong = right + (m.boundary(p) == bool(y)), wrong + (m.boundary(p) != bool(y))
    assert right > 100 and right / (right + wrong) > 0.98


def test_copies_of_a_join_side_are_not_broadcast_and_only_hot_keys_are_copied(spark):
    from graphloom.operators.skew import spread_join

    many = spark.createDataFrame([(i, None if i % 7 == 0 else 5 if i % 2 else i) for i in range(100)], "row long, k long")
    one = spark.createDataFrame([(k, k * 10) for k in range(60)], "k long, v long")
    want = {(i, None if k is None or k >= 60 else k * 10) for i, k in many.collect()}
    for hot in (None, one.filter("k = 5").select("k")):
        joined = spread_join(many, one, ["k"], "row", "left", hot=hot)
        assert {(r.row, r.v) for r in joined.collect()} == want and joined.count() == 100
        assert {(r.row, r.k) for r in spread_join(many, one, ["k"], "row", "left_anti", hot=hot).collect()} == {(i, k) for i, k in many.collect() if k is None or k >= 60}
        last = [line for line in joined._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "__salt" in line]
        assert last and all("SortMergeJoin" in line for line in last)
    rows = spread_join(many, one, ["k"], "row", "left", hot=one.filter("k = 5").select("k"))
    assert "sequence(0, CASE WHEN" in rows._jdf.queryExecution().analyzed().toString()
