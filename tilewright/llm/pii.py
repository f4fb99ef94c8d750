"""Personal data and secrets by weak supervision, in DataFrame operations only.

Base patterns (email, ip, card, phone) are findings as they are. Further candidates (values
that are assigned to the name of a credential, long mixed strings, social security, bank
account and network numbers, phones without a country, account numbers, names after a
title) are put to labelers: shape rules, word lists and context rules vote for, against or
not at all. Expectation maximisation over the votes estimates how reliable each labeler is
and how probable each candidate. A logistic span classifier is trained on these
probabilities; beside the votes it sees what no labeler looks at: the span's length, the
classes and the entropy of its characters, and what stands right before it. It has the last
word on each candidate.

A text is read once. Its matches and the gaps between them leave as small rows (lengths and
the gap's last characters); positions are running sums over a document's own rows.
Candidates are counted by pattern (kind, votes, features), of which there is a fixed number;
only these counts come to the driver, where the estimates are made.

Patterns use possessive repeats where nothing can follow, so the regex engine neither
recurses nor goes back: its work is linear in the text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Base kinds in order. Patterns find the same leftmost matches as the plain
#: ones (noted to the right): a run can only match from its start, or where the last match ended.
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Names that credentials are assigned to.
_SECRETS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key"
#: A text without a match of this has no finding of the kind (empty: of any candidate kind but credentials); one look instead of two cuts.
NEEDS = {
    "email": "@",
    "phone": r"\+",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "credential": rf"""[=:](?<=(?i:{_SECRETS})["']?[\x20\t]{{0,2}}[=:])""",
    # one of several: each starts at a character that is rare in prose, so that the look is quick
    "": (
        r"[0-9](?:[0-9][.-][0-9]{4}|[0-9]{5}|(?=[A-Za-z0-9+/_-]{12})|(?<=[A-Za-z0-9+/_-]{12}))",
        r"[A-Z][A-Z][0-9][0-9]",
        r":[0-9A-Fa-f]{2}:",
        r"[MDPHFS](?:rs?|s|onsieur|adame|rof|err|rau|eñora?)\.?\x20\p{Lu}",
    ),
}

#: Candidate kinds of the method. Credentials are looked for by themselves, the others all at once.
CREDENTIAL = rf"""(?<=[=:\x20\t"'])(?<=(?i:{_SECRETS})["']?[\x20\t]{{0,2}}[=:][\x20\t]{{0,2}}["']?)(?<![A-Za-z0-9])[^\s"'<>,;\[\]=:][^\s"'<>,;\[\]]{{5,}}+"""
CANDIDATES = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])",
    "key": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+",
    "account": r"(?<![A-Za-z0-9.,-])[A-Z]{0,3}[0-9]{6,12}(?![A-Za-z0-9-]|[.,][0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
}
KINDS = ("credential", *CANDIDATES)
CONTEXT = 40
#: Words of the context labelers, by kind.
NEAR = {
    "credential": _SECRETS,
    "ssn": "ssn|social security|sozialversicherung|sécurité sociale|seguro social",
    "tel": "phone|call|tel|fax|mobile|cell|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "mac": "mac|ethernet|hardware address|wlan|wifi",
    "key": "key|token|secret|password|bearer|credential|credentials|auth|authorization|signature|private",
    "account": "account|acct|customer|client|member|membership|passport|licence|license|patient|policy|konto|kunde|kundennummer|compte|cuenta|cliente",
    "name": "name|contact|signed|dear|by|from|author|patient",
}
AGAINST = "version|build|isbn|issn|order|invoice|part no|serial|sku|article|figure|table|sha1|sha256|md5|checksum|digest|commit|revision"
#: Word lists of the gazetteer labeler. Countries whose accounts have an IBAN, with its length.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
#: Common given names of English, German, French and Spanish.
GIVEN_NAMES = (
    "Aaron Adam Adrian Albert Alejandro Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antonio Arthur Barbara Benjamin Bernard Bernd Brian "
    "Camille Carlos Carmen Catherine Charles Charlotte Christian Christine Christopher Claire Claude Claudia Cristina Daniel David Deborah Diego Dieter Donald Dorothy Edward "
    "Elena Elizabeth Emily Emma Eric Erika Eva Fernando Francisco Franz Friedrich Gabriel George Gerhard Hannah Hans Heinz Helen Helga Henri Henry Hugo Ingrid Isabel Jack "
    "Jacques Jakob James Jan Jane Javier Jean Jennifer Jessica Joan John Jonathan Jorge José Joseph Juan Julia Julie Karen Karin Karl Katharina Kevin Klaus Laura Lauren Lea "
    "Léa Leon Linda Lisa Louis Louise Lucas Lucía Luis Lukas Manuel Margaret Maria María Marie Mark Markus Marta Martin Mary Matthew Max Maximilian Michael Michel Miguel "
    "Monika Nancy Nathalie Nicolas Nicole Olivia Olivier Pablo Patricia Patrick Paul Paula Pedro Peter Petra Philippe Pierre Rachel Rafael Raúl Rebecca Richard Robert Rosa "
    "Ruth Sabine Samuel Sandra Sara Sarah Sebastian Sergio Simon Sofia Sophie Stefan Stephen Steven Susan Susanne Sylvie Teresa Thomas Tobias Ursula Walter Werner William Wolfgang"
).replace(" ", "|")
#: What stands in examples where a credential would be, and how the keys of some public services begin.
PLACEHOLDERS = "example|changeme|password|passwd|secret|token|none|null|true|false|undefined|required|optional|string|your.*|x+|\\*+|\\.+|<.*"
KEY_STARTS = "AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abpr]-|eyJ"
LABELERS = ("shape", "variety", "gazetteer", "context", "against")
FEATURES = ("length", "classes", "entropy", "before")
ACCEPT = 0.9

_ORDER = {kind: i for i, kind in enumerate([*BASE, *KINDS])}
#: Candidates are found by kind and, under no name, all others at once.
#: In words only their first letters are looked at: no candidate starts at a small letter after a letter or digit.
SOUGHT = {"credential": CREDENTIAL, "": r"(?:(?![a-z])|(?<![A-Za-z0-9]))(?:" + "|".join(CANDIDATES.values()) + ")"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a finding."""
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.concat(F.lit("0"), F.substring(short(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _zipped(text: Column, pattern: str, needs: str | tuple) -> Column:
    """Pairs (gap, match) of a text; the last gap has a null match. Null without a match of needs, or of any of them."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    some = [F.regexp_like(text, F.lit(p)) for p in ((needs,) if isinstance(needs, str) else needs)]
    return F.when(reduce(Column.__or__, some), pairs)


def _kind_of(m: Column) -> Column:
    kind = F.lit(None).cast("string")
    for k, p in reversed(CANDIDATES.items()):
        # a match alone; what stood around it has been checked
        kind = F.when(F.regexp_like(m, F.lit("^(?:" + p + ")$")), k).otherwise(kind)
    return kind


_ROW = "array<struct<kind:string,i:int,size:bigint,context:string,match:string>>"


def _matches_of(text: Column, kind: str, pattern: str) -> Column:
    """Structs (kind, i, size, context, match); size: with the gap before it. kind is empty for candidates."""

    def row(z: Column, i: Column) -> Column:
        context = F.lit("") if kind in BASE else F.lower(F.right(z["gap"], F.lit(CONTEXT)))
        size = (F.length(z["gap"]) + F.length(z["match"])).cast("long")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), size.alias("size"), context.alias("context"), z["match"].alias("match"))

    found = F.filter(F.transform(_zipped(text, pattern, NEEDS[kind]), row), lambda r: r["match"].isNotNull())
    return F.coalesce(found, F.array().cast(_ROW))


def _rows(text: Column) -> Column:
    """All matches of a text."""
    return F.concat(*[_matches_of(text, kind, p) for kind, p in (BASE | SOUGHT).items()])


def _iban_fits(m: Column) -> Column:
    """Whether the length is the country's and the check digits agree (the number modulo 97 is 1)."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def add(rest: Column, c: Column) -> Column:
        value = F.instr(F.lit(letters), c) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return (F.try_element_at(lengths, F.substring(plain, 1, 2)) == F.length(plain)) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


def votes(kind: Column, m: Column, context: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 no vote, by labeler."""
    pick = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    digits = _digits(m)
    is_ = lambda k: kind == k
    bad_ssn = like(m, "^(000|666|9..)-|-00-|-0000$")
    mixed = like(m, "[0-9]") & like(m, "[A-Za-z]")
    word = like(m, r"^\p{L}+[.!?)]*$")
    slug = like(m, r"^(?:[0-9]*+[a-z]*+[-_/+]|\p{Lu}?[a-z]*+[-_/+])*+[0-9]*+[a-z]*+$")
    shape = (
        F.when(is_("credential"), pick(like(m, "[0-9]") & (F.length(m) >= 8), word))
        .when(is_("ssn"), pick(~bad_ssn, bad_ssn))
        .when(is_("tel"), pick(like(digits, "^[2-9]..[2-9]"), like(digits, "^...[01]")))
        .when(is_("iban"), pick(F.coalesce(_iban_fits(m), F.lit(False)), F.length(F.regexp_replace(m, " ", "")) > 34))
        .when(is_("mac"), pick(~like(m, "^(..)(:\\1)+$"), like(m, "^(..)(:\\1)+$")))
        .when(is_("key"), pick(~slug & (like(m, "^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (like(m, "[a-z]") & like(m, "[A-Z]"))), slug))
        .when(is_("account"), pick(like(m, "[A-Z]") | (F.length(digits) >= 8)))
        .otherwise(pick(like(m, r" \p{Lu}\p{Ll}+ \p{Lu}")))
    )
    kinds_of_digits = F.size(F.array_distinct(F.split(digits, "")))
    kinds_of_letters = F.size(F.array_distinct(F.split(m, "")))
    variety = (
        F.when(is_("name") | is_("mac"), 0)
        .when(is_("credential"), pick((kinds_of_letters >= 6) & ~word, word | (kinds_of_letters <= 3)))
        .when(is_("key"), pick((kinds_of_letters >= 12) & mixed & ~slug, kinds_of_letters <= 6))
        .otherwise(pick(kinds_of_digits >= 4, kinds_of_digits <= 2))
    )
    gazetteer = (
        F.when(is_("iban"), pick(like(m, f"^({'|'.join(IBAN_LENGTHS)})"), ~like(m, f"^({'|'.join(IBAN_LENGTHS)})")))
        .when(is_("name"), pick(like(m, f" ({GIVEN_NAMES})( |$)")))
        .when(is_("credential"), pick(F.lit(False), like(m, f"^(?i:{PLACEHOLDERS})$")))
        .when(is_("key"), pick(like(m, f"^({KEY_STARTS})")))
        .otherwise(0)
    )
    near = F.lit(False)
    for k, words in NEAR.items():
        near = F.when(is_(k), like(context, rf"(?<![a-z])({words})(?![a-z])")).otherwise(near)
    against = pick(F.lit(False), like(context, rf"\b({AGAINST})\b"))
    return dict(zip(LABELERS, (shape, variety, gazetteer, pick(near), against), strict=True))


def features(m: Column, context: Column) -> dict[str, Column]:
    """What the classifier sees beside votes: small numbers."""
    n = F.length(m)
    has = lambda p, bit: F.when(F.regexp_like(m, F.lit(p)), bit).otherwise(0)
    chars = F.split(m, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n.cast("double")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    last = F.right(F.regexp_replace(context, "[\\s\"']+$", ""), F.lit(1))
    before = F.when(last == "", 0).when(F.regexp_like(last, F.lit(r"\p{L}")), 1).when(last.isin("=", ":"), 2).when(F.regexp_like(last, F.lit("[0-9]")), 3).otherwise(4)
    return dict(zip(FEATURES, (F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3), has("[0-9]", 1) + has("[a-z]", 2) + has("[A-Z]", 4) + has("[^0-9A-Za-z]", 8), F.floor(F.least(entropy, F.lit(5.0))).cast("int"), before), strict=True))


def estimate(patterns: list[tuple], rounds: int = 30) -> list[float]:
    """Probability of each vote pattern (v1..vn, count), by expectation maximisation.

    Labelers err independently given the truth. What a vote is worth starts at a mild
    trust and is smoothed by it, so that few candidates cannot overturn it.
    """
    n = len(patterns[0]) - 1 if patterns else 0
    start = {True: {1: 0.6, 0: 0.35, -1: 0.05}, False: {1: 0.1, 0: 0.6, -1: 0.3}}
    worth = [{y: dict(start[y]) for y in start} for _ in range(n)]
    prior, prob = 0.3, [0.0] * len(patterns)
    for _ in range(rounds):
        for i, row in enumerate(patterns):
            yes = math.log(prior) + sum(math.log(worth[j][True][row[j]]) for j in range(n))
            no = math.log(1 - prior) + sum(math.log(worth[j][False][row[j]]) for j in range(n))
            prob[i] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        total = sum(row[n] for row in patterns)
        prior = (sum(p * row[n] for p, row in zip(prob, patterns, strict=True)) + 3) / (total + 10) if total else prior
        for j in range(n):
            for y in start:
                mass = {v: 20 * start[y][v] for v in (1, 0, -1)}
                for p, row in zip(prob, patterns, strict=True):
                    mass[row[j]] += row[n] * (p if y else 1 - p)
                worth[j][y] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return prob


def train(rows: list[tuple[tuple, float, float]], steps: int = 400, rate: float = 0.5) -> dict:
    """Weights of a logistic classifier on (names of true features, probability, count)."""
    weights: dict = {}
    total = sum(c for _, _, c in rows) or 1
    for _ in range(steps):
        slope = {k: 0.001 * w for k, w in weights.items()}
        for names, target, count in rows:
            z = sum(weights.get(k, 0.0) for k in names)
            gap = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - target) * count / total
            for k in names:
                slope[k] = slope.get(k, 0.0) + gap
        for k, s in slope.items():
            weights[k] = weights.get(k, 0.0) - rate * s
    return weights


def _names(row) -> tuple:
    """The true features of a pattern."""
    return ("bias", ("kind", row["kind"]), *((c, row[c]) for c in (*LABELERS, *FEATURES)))


def _fitted(counted: list) -> tuple[list[float], dict]:
    """Probabilities of the patterns, by their votes alone, and the classifier's weights."""
    prob = estimate([(*(r[v] for v in LABELERS), r["count"]) for r in counted])
    return prob, train([(_names(r), p, r["count"]) for r, p in zip(counted, prob, strict=True)])


def _patterns(candidates: DataFrame) -> list:
    """Counts of the patterns (kind, votes, features)."""
    by = ["kind", *LABELERS, *FEATURES]
    return sorted(candidates.groupBy(*by).count().collect(), key=lambda r: tuple(r[c] for c in by))


def _score(weights: dict, said: dict[str, Column]) -> Column:
    """The classifier's probability of a candidate with these votes, features and kind."""
    score = F.lit(weights.get("bias", 0.0))
    for (name, value), w in ((k, w) for k, w in weights.items() if k != "bias"):
        score = score + F.when(said[name] == value, w).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def _accepted(weights: dict, said: dict[str, Column]) -> Column:
    """The classifier's verdict; a lone vote never suffices."""
    return (_score(weights, said) >= ACCEPT) & (sum((F.when(said[v] == 1, 1).otherwise(0) for v in LABELERS), F.lit(0)) >= 2)


def held_out_quality(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """How the classifier, trained on three quarters of the candidates, agrees with the labels of the rest.

    Labels are the estimated probabilities of the votes of all candidates. Gives the number
    of candidates held out, the precision and the recall of its verdicts; each is 1 where
    there is nothing to be wrong about.
    """
    asked = _asked(_matches(docs, text_col, lambda text: F.concat(*[_matches_of(text, k, p) for k, p in SOUGHT.items()])))
    asked = cut(asked.withColumn("test", F.pmod(F.xxhash64("uid", "i", "kind"), F.lit(4)) == 0))
    prob = {}
    every = _patterns(asked)
    for r, p in zip(every, _fitted(every)[0], strict=True):
        prob[tuple(r[v] for v in LABELERS)] = p
    _, weights = _fitted(_patterns(asked.filter("not test")))
    yes = said = right = total = 0.0
    for r in _patterns(asked.filter("test")):
        z = sum(weights.get(k, 0.0) for k in _names(r))
        accepted = 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) >= ACCEPT and sum(r[v] == 1 for v in LABELERS) >= 2
        label = prob[tuple(r[v] for v in LABELERS)] >= ACCEPT
        total, yes, said, right = total + r["count"], yes + label * r["count"], said + accepted * r["count"], right + (label and accepted) * r["count"]
    return {"candidates": total, "precision": right / said if said else 1.0, "recall": right / yes if yes else 1.0}


def _matches(docs: DataFrame, text_col: str, rows_of=_rows) -> DataFrame:
    """(uid, kind, i, size, context, match) of all matches, in one pass over the texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), text_of(text_col).alias("text"))
    return rows.select("uid", F.explode(rows_of(F.col("text"))).alias("m")).select("uid", "m.*")


def _asked(matches: DataFrame) -> DataFrame:
    """Candidates with their kinds and votes."""
    asked = matches.filter(F.col("kind").isin(*SOUGHT)).withColumn("kind", F.when(F.col("kind") == "", _kind_of(F.col("match"))).otherwise(F.col("kind"))).filter("kind is not null")
    return asked.withColumns(votes(F.col("kind"), F.col("match"), F.col("context")) | features(F.col("match"), F.col("context")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans: a row for each row of docs.

    Spans are kind:start:end in code points (end exclusive), by kind and start, joined by
    commas; an empty string without any. Added spans that touch a base span are left out,
    as are those that touch a credential. n_added is the number of added spans.
    A null text counts as empty. Null and repeated ids are kept; further columns are not
    read. An empty table gives an empty result. docs must be stable when read twice.
    """
    found = cut(_matches(docs, text_col).withColumn("end", F.sum("size").over(Window.partitionBy("uid", "kind").orderBy("i"))))
    found = found.withColumn("start", F.col("end") - F.length("match"))
    base = F.lit(False)
    for kind in BASE:
        base = F.when(F.col("kind") == kind, valid(kind, F.col("match"))).otherwise(base)
    span = lambda order, kind: F.struct(order.cast("int").alias("o"), "start", "end", kind.alias("kind"))
    order = F.create_map(*[F.lit(x) for pair in _ORDER.items() for x in pair])
    certain = found.filter(F.col("kind").isin(*BASE) & base).select("uid", span(order[F.col("kind")], F.col("kind")).alias("span"))
    asked = _asked(found)
    _, weights = _fitted(_patterns(asked))
    added = asked.filter(_accepted(weights, {c: F.col(c) for c in ("kind", *LABELERS, *FEATURES)})).select("uid", span(order[F.col("kind")], F.col("kind")).alias("span"))
    every = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.lit(True).alias("here"))
    rows = every.unionByName(certain.unionByName(added), allowMissingColumns=True)
    docs_ = rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("here").alias("here"), F.sort_array(F.collect_list("span")).alias("s"))
    docs_ = docs_.filter("here").select("doc_id", F.filter("s", lambda x: x["o"] < len(BASE)).alias("b"), F.filter("s", lambda x: x["o"] >= len(BASE)).alias("a"))
    touches = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    credentials = F.filter("a", lambda x: x["kind"] == "credential")
    free = F.filter("a", lambda x: ~F.exists("b", lambda y: touches(x, y)) & ((x["kind"] == "credential") | ~F.exists(credentials, lambda y: touches(x, y))))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("b", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs_.select(
        "doc_id", *[count(k) for k in BASE], F.size(free).cast("long").alias("n_added"), F.sha2(told(F.col("b")).cast("binary"), 256).alias("base_sha256"), told(F.concat("b", free)).alias("spans")
    )


def _marked(text: Column, kind: str, pattern: str) -> Column:
    """The text with a mark in place of a base kind's findings."""

    def piece(z: Column) -> Column:
        own = F.when(z["match"].isNull(), "").when(valid(kind, z["match"]), f"[{kind.upper()}]").otherwise(z["match"])
        return F.concat(z["gap"], own)

    return F.coalesce(F.array_join(F.transform(_zipped(text, pattern, NEEDS[kind]), piece), ""), text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a mark such as [EMAIL] in place of each finding; all columns and rows stay.

    Kinds are taken in order, so of findings that overlap the first kind's is marked. A
    null text stays null. n_chars, where there is such a column, follows the new text.
    The classifier learns from candidates of the unmarked texts, but judges those of the
    marked ones: a mark before a candidate can make for one vote more.
    """
    asked = _asked(_matches(docs, text_col, lambda text: F.concat(*[_matches_of(text, k, p) for k, p in SOUGHT.items()])))
    _, weights = _fitted(_patterns(asked))
    text = F.col(text_col)
    out = docs
    for kind, pattern in BASE.items():
        out = out.withColumn(text_col, _marked(text, kind, pattern))

    def marked(z: Column, name: str) -> Column:
        context = F.lower(F.right(z["gap"], F.lit(CONTEXT)))
        kind = F.lit(name) if name else _kind_of(z["match"])
        said = {"kind": kind} | votes(kind, z["match"], context) | features(z["match"], context)
        own = F.when(_accepted(weights, said), F.concat(F.lit("["), F.upper(kind), F.lit("]"))).otherwise(z["match"])
        return F.concat(z["gap"], F.when(z["match"].isNull(), "").otherwise(own))

    for name, pattern in SOUGHT.items() if weights else ():
        pairs = _zipped(text, pattern, NEEDS[name])
        out = out.withColumn(text_col, F.coalesce(F.array_join(F.transform(pairs, lambda z: marked(z, name)), ""), text))  # noqa: B023
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
