import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex
from oracle import SF
from pyspark.sql import functions as F

from tilewright.llm import langid, pii, queries, url_filter


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]


def rule_for(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "://", "HTTP://A.Example.COM/en/1?x=/en/", "https://example.com/en/7#f", "http://com/en/", "http://xcom/en/", "ftp://net/de/?q", "http://a.example.net/de/88", "http://ÄB.org/es/é", "a://b://c/d", "http://x.org?/es/", "http://x.org#/es/", "http://a\x01b.org/\x02\x01", "http://\x02.net/x"]


def pages(stored, extra=()):
    rng = random.Random(6)
    rows = [(k, f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'www.b', 'example', 'shop'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(0, 99)}") for k in range(300)]
    rows += [(1000 + k, u) for k, u in enumerate(ODD)] + [(None, rows[0][1]), (0, rows[0][1]), *extra]
    return rows, stored(rows, "page_id long, url string", clash=False).selectExpr("*", "'?' as host", "'?' as path", "1 as w", "2 as a", "3 as r", "'<p>' as html")


def test_urls_rules_and_models(stored):
    rows, df = pages(stored)
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    want = sorted(((str(i), *host_path(u), rule_for(*host_path(u))[0]) for i, u in rows), key=str)
    assert sorted(((str(r.page_id), r.host, r.path, r.rule) for r in got), key=str) == want
    scores = brute_scores(rows)
    for r in got:
        assert math.isclose(r.score, scores[r.host, r.path], rel_tol=1e-9, abs_tol=1e-9)
        decided = rule_for(r.host, r.path)[1]
        assert r.verdict == decided if decided else r.verdict in ("allow", "block")
    limit = brute_threshold(rows, scores)
    assert all(r.verdict == ("allow" if r.score >= limit else "block") for r in got if not r.rule)
    assert {r.verdict for r in got if not r.rule} == {"allow", "block"}


def brute_threshold(rows, scores):
    """Of all steps, the one with the best mean of accepted rows at or above and rejected rows below it."""
    test = spark_hash_test(rows)
    judged = [(scores[h, p], v) for h, p, v in ((*host_path(u), rule_for(*host_path(u))[1]) for _, u in rows) if v and test[h, p]]
    good, bad = ([s for s, v in judged if v == want] for want in ("allow", "block"))
    if not good or not bad:
        return 0.0
    steps = range(-url_filter.BINS, url_filter.BINS + 1)
    step = lambda s: max(-url_filter.BINS, min(url_filter.BINS, math.floor(s / url_filter.STEP)))
    worth = lambda k: (sum(step(s) >= k for s in good) / len(good) + sum(step(s) < k for s in bad) / len(bad), -abs(k), k)
    return max(map(worth, steps))[2] * url_filter.STEP


def spark_hash_test(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    pairs = sorted({host_path(u) for _, u in rows})
    df = spark.createDataFrame(pairs, "host string, path string")
    return {(r.host, r.path): r.t for r in df.withColumn("t", F.pmod(F.xxhash64("host", "path"), F.lit(4)) == 0).collect()}


def brute_scores(rows, order=url_filter.ORDER):
    test = spark_hash_test(rows)
    count, seen = [{} for _ in "ar"], set()
    marked = lambda h, p: "\x01" * order + (h + p).translate({1: 0xFFFD, 2: 0xFFFD}) + "\x02"
    for _, u in rows:
        h, p = host_path(u)
        verdict = rule_for(h, p)[1]
        s = marked(h, p)
        for k in range(order, len(s)):
            for n in range(order + 1):
                g = s[k - n : k + 1]
                seen.add(g)
                if verdict and not test[h, p]:
                    c = count[verdict == "block"]
                    c[g] = c.get(g, 0) + 1

    def logp(c, s, k):
        prob = 1 / 65536
        for n in range(order + 1):
            context = s[k - n : k]
            after = [v for g, v in c.items() if len(g) == n + 1 and g[:-1] == context]
            if after:
                prob = (c.get(s[k - n : k + 1], 0) + len(after) * prob) / (sum(after) + len(after))
        return math.log(prob)

    out = {}
    for h, p in {host_path(u) for _, u in rows}:
        s = marked(h, p)
        out[h, p] = sum(logp(count[0], s, k) - logp(count[1], s, k) for k in range(order, len(s))) / (len(s) - order)
    return out


def test_urls_shuffled_lookup_and_empty(stored, monkeypatch):
    rows, df = pages(stored)
    one = sorted(url_filter.judge(df).collect(), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_WINDOWS", 0)
    two = sorted(url_filter.judge(df).collect(), key=str)
    assert [r[:5] for r in one] == [r[:5] for r in two]
    assert url_filter.judge(df.limit(0)).count() == 0
    unlabelled = stored([(1, "http://q.de/x")], "page_id long, url string", clash=False)
    assert url_filter.judge(unlabelled).first().verdict == "allow"


def base_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


PARTS = ["a", "b@c.d", "@", ".", "1", "22", "255", "256", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+1", "(", "x_y%", "é", "😀", "\n", "+49 30 1234567", "1.2.3.4", "00"]


def test_base_spans_against_plain_patterns(stored, edges, empty):
    from edge_rows import EDGES

    rng = random.Random(7)
    rows = [(k, "".join(rng.choices(PARTS, k=rng.randint(0, 14)))) for k in range(1500)]
    rows += [(10**6, "1 " * 2000), (10**6 + 1, "a" * 2000 + "@b.c"), (10**6 + 2, "1." * 2000), (10**6 + 3, "a@" + "b." * 2000 + "c"), (10**6 + 4, "4111111111111111 x " * 500)]
    for df, table in ((stored(rows), rows), (edges, EDGES)):
        got = pii.find_personal_data(df).collect()
        want = sorted((str(i), hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t in table)
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    mail = next(r for r in got if r.doc_id == 2**62 + 1)
    assert (mail.n_email, mail.n_ip, mail.n_card, mail.n_phone) == (1, 1, 1, 1)
    assert pii.find_personal_data(empty).count() == 0


def test_personal_data_query(spark):
    from tilewright.llm.common import table

    text = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op6_personal_data(spark, SF).collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        spans = base_spans(t)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k + ":") for s in spans) for k in pii.BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and got[i].spans.split(",")[: len(spans)] == (spans or got[i].spans.split(",")[:0])


def test_url_query_and_threshold(spark):
    from tilewright.llm.common import table

    rows = [(r.page_id, r.url) for r in table(spark, SF, "pages").select("page_id", "url").collect()]
    got = {r.page_id: r for r in queries.op2_url_filter(spark, SF).collect()}
    scores = brute_scores(rows)
    limit = brute_threshold(rows, scores)
    for i, u in rows:
        h, p = host_path(u)
        rule, verdict = rule_for(h, p)[0], rule_for(h, p)[1]
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule) and math.isclose(got[i].score, scores[h, p], rel_tol=1e-9, abs_tol=1e-9)
        assert got[i].verdict == (verdict or ("allow" if got[i].score >= limit else "block"))


def test_long_runs_stay_linear(stored):
    rows = [(1, "1 " * 200_000), (2, "a" * 400_000), (3, "1." * 150_000), (4, "+1" + "-" * 300_000 + "2")]
    got = {r.doc_id: r for r in pii.find_personal_data(stored(rows, clash=False)).collect()}
    assert got[3].n_ip == 37_500 and got[1].n_card == got[2].n_email == got[4].n_phone == 0


def test_labelers_add_spans_and_leave_prose_alone(stored):
    rows = [(k, f"Her social security number is {k % 89 + 100:03d}-{k % 97 + 1:02d}-{k * 37 % 9000 + 1000} on file.") for k in range(60)]
    rows += [(100 + k, f"See part no {k:03d}-00-0000 in the catalogue, version 000-11-1111.") for k in range(60)]
    rows += [(200 + k, "Nothing here but words, a year 1999 and a price of 3.50.") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(stored(rows)).collect()}
    assert sum("ssn" in got[k] for k in range(60)) >= 55
    assert not any(got[k] for k in got if k >= 100)


def secrets(rng, n=80):
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows = [(k, f'Some words here. token = "{hexes(40)}" and more words.') for k in range(n)]
    rows += [(1000 + k, f"The password: {rng.choice(['Tr0ub4dor', 'x9!kQ2z7', 'hunter2023'])}{k} is old.") for k in range(n)]
    rows += [(2000 + k, f"He asked for the bearer {rng.choice(['AKIA', 'ghp_'])}{''.join(rng.choices('ABCDEFGHJKLMabcdefghjk23456789', k=30))} again.") for k in range(n)]
    rows += [(3000 + k, f"Customer {rng.choice(['A', 'KD', ''])}{rng.randint(10**8, 10**9)} called.") for k in range(n)]
    rows += [(4000 + k, f"password = {w} and the-long-name-of-a-page-number-{k}-in-a-web-address/of/words version 1000{k:04d}") for k, w in enumerate(["example", "changeme", "xxxxxx", "password"] * 5)]
    rows += [(5000 + k, "Nothing to see but prose about a token of thanks and the key to it all.") for k in range(n)]
    rows += [(6000 + k, f"My IBAN DE{98 - int(f'37040044{k:010d}131400') % 97:02d}37040044{k:010d} is here.") for k in range(n)]
    return rows


def test_secrets_and_accounts(stored):
    rows = secrets(random.Random(5))
    df = stored(rows)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    text = dict(rows)

    def found(k, kind):
        return [text[k][int(a) : int(b)] for x, a, b in (s.split(":") for s in got[k].spans.split(",") if s) if x == kind]

    assert all(len(v := found(k, "credential")) == 1 and len(v[0]) == 40 for k in range(80))
    assert sum(bool(found(1000 + k, "credential")) for k in range(80)) >= 76
    assert sum(bool(found(2000 + k, "key")) for k in range(80)) >= 76
    assert sum(bool(found(3000 + k, "account")) for k in range(80)) >= 76
    assert sum(bool(found(6000 + k, "iban")) for k in range(80)) >= 76
    assert not any(got[k].n_added for k in got if 4000 <= k < 6000)
    assert all(got[k].n_added == len([s for s in got[k].spans.split(",") if s]) - sum(got[k][f"n_{b}"] for b in pii.BASE) for k in got)
    quality = pii.held_out_quality(df)
    assert quality["candidates"] > 50 and quality["precision"] > 0.95 and quality["recall"] > 0.95
    marked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert marked[0] == 'Some words here. token = "[CREDENTIAL]" and more words.' and marked[5000] == text[5000] and marked[4000] == text[4000]


def plain_candidates(text):
    """(kind, start, end, the up to 40 characters before, from the match before) by this module's patterns, one kind's pass after the other."""
    for name, pattern in pii.SOUGHT.items():
        at = 0
        for m in regex.finditer(pattern, text):
            kind = name or next(k for k, p in pii.CANDIDATES.items() if regex.fullmatch(p, m[0]))
            yield kind, m.start(), m.end(), text[max(at, m.start() - 40) : m.start()].lower()
            at = m.end()


def plain_votes(kind, m, context):
    """The labelers once more, for the kinds of secrets()."""
    digits, letters = re.sub("[^0-9]", "", m), len(set(m))
    sign = lambda yes, no=False: 1 if yes else -1 if no else 0
    few = sign(len(set(digits)) >= 4, len(set(digits)) <= 2)
    near = sign(regex.search(rf"(?<![a-z])({pii.NEAR[kind]})(?![a-z])", context))
    against = -1 if regex.search(rf"\b({pii.AGAINST})\b", context) else 0
    if kind == "credential":
        word = regex.search(r"^\p{L}+[.!?)]*$", m)
        shape, variety = sign(digits and len(m) >= 8, word), sign(letters >= 6 and not word, word or letters <= 3)
        return shape, variety, sign(False, regex.fullmatch(f"(?i:{pii.PLACEHOLDERS})", m)), near, against
    if kind == "key":
        mixed = regex.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", m) or (regex.search("[a-z]", m) and regex.search("[A-Z]", m))
        slug = all(regex.fullmatch(r"[0-9]*[a-z]*|\p{Lu}?[a-z]*", x) for x in regex.split("[-_/+]", m)[:-1]) and regex.fullmatch("[0-9]*[a-z]*", regex.split("[-_/+]", m)[-1])
        return sign(mixed and not slug, slug), sign(letters >= 12 and digits and regex.search("[A-Za-z]", m) and not slug, letters <= 6), sign(regex.match(pii.KEY_STARTS, m)), near, against
    if kind == "account":
        return sign(regex.search("[A-Z]", m) or len(digits) >= 8), few, 0, near, against
    assert kind == "iban"
    turned = "".join(str(int(c, 36)) for c in m[4:] + m[:4])
    fits = pii.IBAN_LENGTHS.get(m[:2]) == len(m) and int(turned) % 97 == 1
    return sign(fits, len(m) > 34), few, sign(m[:2] in pii.IBAN_LENGTHS, True), near, against


def plain_features(m, context):
    size = sum(len(m) >= k for k in (12, 20, 40))
    classes = sum(bit for p, bit in (("[0-9]", 1), ("[a-z]", 2), ("[A-Z]", 4), ("[^0-9A-Za-z]", 8)) if re.search(p, m))
    entropy = -sum(m.count(c) / len(m) * math.log2(m.count(c) / len(m)) for c in set(m))
    last = context.rstrip(" \t\n\"'")[-1:]
    return size, classes, int(min(entropy, 5.0) + 1e-12), 0 if not last else 1 if last.isalpha() else 2 if last in "=:" else 3 if last.isdigit() else 4


def test_added_spans_against_brute_force(stored):
    rows = secrets(random.Random(9), 30)
    counts, asked = {}, []
    for i, t in rows:
        for kind, a, b, context in plain_candidates(t):
            pattern = (kind, *plain_votes(kind, t[a:b], context), *plain_features(t[a:b], context))
            counts[pattern] = counts.get(pattern, 0) + 1
            asked.append((i, a, b, pattern))
    columns = ("kind", *pii.LABELERS, *pii.FEATURES, "count")
    counted = [dict(zip(columns, (*p, n), strict=True)) for p, n in sorted(counts.items())]
    _, weights = pii._fitted(counted)
    want = {i: [] for i, _ in rows}
    for i, a, b, pattern in asked:
        z = sum(weights.get(k, 0.0) for k in pii._names(dict(zip(columns, (*pattern, 0), strict=True))))
        if 1 / (1 + math.exp(-z)) >= pii.ACCEPT and sum(v == 1 for v in pattern[1:6]) >= 2:
            want[i].append((pattern[0], a, b))
    got = {r.doc_id: [tuple(s.split(":")) for s in r.spans.split(",") if s and s.split(":")[0] not in pii.BASE] for r in pii.find_personal_data(stored(rows)).collect()}
    for i, t in rows:
        base = [s.split(":") for s in base_spans(t)]
        free = [x for x in want[i] if not any(x[1] < int(e) and int(s) < x[2] for _, s, e in base)]
        sure = [x for x in free if x[0] == "credential" or not any(y[0] == "credential" and x[1] < y[2] and y[1] < x[2] for y in want[i])]
        order = {k: n for n, k in enumerate(pii.KINDS)}
        assert [(k, int(a), int(b)) for k, a, b in got[i]] == sorted(sure, key=lambda x: (order[x[0]], x[1])), t
    assert sum(map(len, got.values())) > 100


def test_redaction(edges, stored):
    out = pii.redact(edges)
    assert out.columns == edges.columns and out.dtypes == edges.dtypes and out.count() == 15
    mail = out.filter(F.col("doc_id") == 2**62 + 1).first()
    assert mail.text == "Mail me: [EMAIL] or [PHONE], [IP], [CARD]." and mail.n_chars == len(mail.text)
    assert out.filter("doc_id = 3").first().text is None
    assert out.filter("doc_id = 7").first().text == "word " * 30_000


def test_redaction_of_what_a_mark_gives_a_vote(stored):
    # the mark [PHONE] is a word of context that no candidate has in the unmarked texts
    rows = [(k, f"Reach us under {k % 700 + 215}-{k % 90 + 231}-{k * 37 % 9000 + 1000} today.") for k in range(80)]
    rows += [(100 + k, f"See part no {k + 100:03d}-011-1111 in the catalogue.") for k in range(80)]
    rows.append((500, "Reach us under +44 20 7946 0958 / 415-555-2671 today."))
    docs = stored(rows)
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert "phone" in spans[500] and "tel" in spans[500]
    assert pii.redact(docs).filter("doc_id = 500").first().text == "Reach us under [PHONE] / [TEL] today."


def test_estimates_agree_with_the_votes():
    patterns = [(1, 1, 0, 50), (1, 0, 0, 20), (0, 0, 0, 30), (-1, 0, -1, 50), (-1, -1, 0, 10)]
    p = pii.estimate(patterns)
    assert p[0] > 0.9 and p[3] < 0.1 and p[0] > p[1] > p[2] > p[4] and pii.estimate([]) == []


def test_language_held_out_accuracy(spark):
    from tilewright.llm.common import table

    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and len(held) > 200
    assert (held["lang_pred"] == held["lang"]).mean() > 0.99
    assert got["score"].between(0, 1).all()


def test_language_edges(edges, empty, stored, spark):
    got = {str(r.doc_id): r for r in langid.identify(edges).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {"3", "4", "5", "6"} and got["3"].score == 0
    kept = langid.keep_known(edges)
    assert kept.columns == edges.columns and kept.count() == 10
    assert 2**62 + 1 in [r.doc_id for r in kept.select("doc_id").collect()]
    assert langid.identify(empty).count() == 0
    unlabelled = stored([(1, "some words")], clash=False).withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_no_language_learned_keeps_texts_with_a_letter(stored):
    rows = [(1, "some words"), (2, "12 34"), (3, None), (4, "é"), (5, "")]
    unlabelled = stored(rows, clash=False).withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_known(unlabelled)
    assert kept.columns == unlabelled.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def labelled(stored, rows):
    return stored([(i, t) for i, t, _ in rows], clash=False).join(stored([(t, lang) for _, t, lang in rows], "text string, lang string", clash=False).distinct(), "text", "left")


WORDS = {"en": "the of and to in is that for it was".split(), "fr": "le de et la les des en un une est".split(), "de": "der die und das von zu mit den ist ein".split()}


def prose(lang, seed, n=20):
    return " ".join(random.Random(f"{lang}{seed}").choices(WORDS[lang], k=n))


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 10])
def test_languages_of_rows_without_ids_of_their_own(stored, ids):
    rows = [(k, prose("en", k), "en") for k in range(400)] + [(ids(k), prose("fr", k), "fr") for k in range(400)]
    got = langid.identify(labelled(stored, rows)).collect()
    assert sum(r.lang_pred == "fr" for r in got) == 400 and sum(r.lang_pred == "en" for r in got) == 400


def test_the_sample_is_exact_and_bounded(stored, monkeypatch):
    drawn = {}
    monkeypatch.setattr(langid.Hierarchy, "__init__", lambda self, x, langs: drawn.update({s: langs.count(s) for s in langs}))
    rows = [(k, prose("en", k), "en") for k in range(900)] + [(k, prose("fr", k), "fr") for k in range(30)] + [(5, prose("de", 0), "de")] * 700
    rows += [(k, "17 4", "de") for k in range(500)]  # no letter: nothing to learn
    df = stored([(i, t) for i, t, _ in rows], clash=False).withColumn("lang", F.when(F.col("text").rlike("der|die|das|[0-9]|zu|und"), "de").when(F.col("text").rlike("les|des|une|est"), "fr").otherwise("en"))
    langid.fit(df, sample=100)
    assert drawn == {"en": 100, "fr": 30, "de": 1}
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    drawn.clear()
    langid.fit(df, sample=100)
    assert drawn == {"en": 100, "de": 1}  # most documents


def plain_counts(text):
    folded = "".join(chr(b) if b >= 128 or 97 <= b <= 122 else " " for b in text.lower().encode())
    b = [ord(c) for c in " " + " ".join(x for x in folded.split(" ") if x) + " "]
    counts = [0] * langid.FEATURES
    for k in range(len(b) - 1):
        counts[(((b[k] << 8 | b[k + 1]) * 2654435761) & 0xFFFFFFFF) >> 20] += 1
    for k in range(len(b) - 2):
        counts[(((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2246822519 + 374761393) & 0xFFFFFFFF) >> 20] += 1
    total = max(1, sum(counts))
    return np.sqrt(np.array(counts) / total)


def plain_machine(x, y, cost=50.0, steps=200):
    """The same steps in double precision, a row at a time."""
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    share = {s: 0.5 / max(1, sum(t == s for t in y)) for s in (1, -1)}
    for t in range(steps):
        slope = np.zeros_like(v)
        for row, s in zip(x, y):
            slope += share[s] * s * max(0.0, 1 - s * (row @ v[:-1] + v[-1])) * np.append(row, 1.0)
        step = v - (v - 2 * cost * slope) / (1 + 4 * cost)
        v, w = step + t / (t + 3) * (step - w), step
    return w


def test_language_against_brute_force(stored):
    rows = [(k, prose(lang, k, 6), lang) for lang in ("en", "fr", "de") for k in range(12)] + [(90, None, None), (91, "12", None), (92, "the le und", None)]
    df = stored([(i, t) for i, t, _ in rows], clash=False).withColumn("lang", F.lit(None).cast("string"))
    names = {t: lang for _, t, lang in rows if lang}
    pairs = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    df = df.withColumn("lang", pairs[F.col("text")])
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(df).collect()}
    import zlib

    learn = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.stack([plain_counts(t) for t, _ in learn])
    fam = {"en": "germanic", "de": "germanic", "fr": "romance"}
    top = plain_machine(x, [1 if fam[lang] == "germanic" else -1 for _, lang in learn])
    low_rows = [k for k, (_, lang) in enumerate(learn) if fam[lang] == "germanic"]
    low = plain_machine(x[low_rows], [1 if learn[k][1] == "de" else -1 for k in low_rows])
    sure = lambda m: 1 / (1 + math.exp(-3 * m))
    for i, t, _ in rows:
        if t is None or t == "12":
            assert got[i, "und"].score == 0
            continue
        f = plain_counts(t)
        m = f @ top[:-1] + top[-1]
        want, score = ("fr", sure(-m)) if m < 0 else (None, sure(m))
        if want is None:
            n = f @ low[:-1] + low[-1]
            want, score = ("de", score * sure(n)) if n >= 0 else ("en", score * sure(-n))
        assert math.isclose(got[i, want].score, score, abs_tol=2e-3), (i, t)


def test_language_filter_goes_by_the_prediction(stored):
    rows = [(k, prose(lang, k), lang) for lang in ("en", "fr") for k in range(60)]
    df = labelled(stored, rows)
    answers = langid.identify(df)
    odd = stored([(1000, "zqx"), (1001, "the le"), (1002, "..")], clash=False).select("text", "doc_id", F.lit(None).cast("string").alias("lang"))
    both = df.select("text", "doc_id", "lang").unionByName(odd)
    predicted = langid.identify(both).collect()
    for languages, floor in ((None, 0.4), (None, 0.7), (["fr"], 0.4), ([], 0.0)):
        want = sorted(r.doc_id for r in predicted if r.lang_pred != "und" and r.score >= floor and (languages is None or r.lang_pred in languages))
        kept = langid.keep_known(both, languages, floor)
        assert kept.columns == both.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert answers.filter("score < 0.7").count() == 0  # clean prose is far from the floor


def test_language_is_judged_by_text_alone(spark):
    from tilewright.llm.common import table

    docs = table(spark, SF, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    swapped = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("?"), "doc_id": F.col("doc_id") + 7})
    one = langid.predict(docs, model, [F.col("doc_id").alias("k")]).collect()
    two = langid.predict(swapped, model, [(F.col("doc_id") - 7).alias("k")]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_svm_parts_two_clouds():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1, 1, (200, 20)), rng.normal(-1, 1, (50, 20))]).astype(np.float32) / 10
    y = np.array([1.0] * 200 + [-1.0] * 50, np.float32)
    w = langid.fit_svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("lang,want", [("en", "germanic"), ("es", "romance"), ("zz", "zz")])
def test_families(lang, want):
    assert langid.family(lang) == want
