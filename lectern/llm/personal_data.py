"""Personal data by weak supervision, in DataFrame operations only.

Strict patterns give the base spans, which always stay; wider patterns give
further candidates. Labelers vote on each candidate: the strict check, the
format, gazetteers of words before and after it, its surroundings, and words
that speak against it. Expectation-maximisation over the counts of vote patterns
estimates each labeler's reliability. A logistic classifier over the span itself
(length, digits, separators, lead, neighbouring characters and words, place in
its line) learns from the posteriors and decides the candidates that aren't
base: what it knows of a shape it says of spans on which labelers are silent.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import table

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Lookbehinds and possessive repeats only spare the engine starts that can't match:
# a run of the first class is entered at its start, or where the match before it ended.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 13 to 19 digits with single separators: a match of the contract's pattern is such a run, longer and shorter ones fail
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?+[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++[ ]?(?:\[at\]|\(at\)|\{{at\}})[ ]?[A-Za-z0-9-]++(?:[ ]?(?:\.|\[dot\]|\(dot\)|\{{dot\}})[ ]?[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?=[0-9])(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[\x20.-])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4})(?![0-9])",
    "phone": r"(?=[+(0-9])(?<![0-9+.(-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A cheap test without which neither pattern can match.
NEEDS = {"email": "@|[\\[({]at[\\])}]", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]", "phone": "[0-9]"}
# Words that go with data of a kind, and words that go with other numbers.
GAZETTEER = {
    "email": "email e-mail mail mails mailto contact write address reach reply adresse courriel correo kontakt schreiben escriba contacter inbox sender recipient newsletter support info",
    "ip": "ip ipv4 ipv6 host server client login gateway dns router subnet address adresse proxy peer remote origin node endpoint machine",
    "card": "card cards visa mastercard amex discover maestro credit debit payment pay pan karte kreditkarte carte tarjeta cvv expiry account iban",
    "phone": "phone phones tel telephone call mobile cell fax hotline dial ring text sms whatsapp telefon telefono teléfono téléphone handy movil móvil portable rufnummer numero número office desk",
}
AFTER = {
    "email": "for or and with before if cc bcc",
    "ip": "port host server gateway netmask subnet over",
    "card": "exp expires expiry cvv cvc valid gültig valable",
    "phone": "ext extension or fax mobile office home weekdays daily between from anytime",
}
AGAINST = "version release order invoice isbn issn section chapter figure fig table token hash serial part build revision page lines id ticket case item model sku tracking ratio score total sum"
LABELERS = 6
#: Characters of a span's surroundings that labelers and the classifier look at.
BEFORE, BEHIND = 40, 24
#: A piece of 4,000 characters or more, up to where no pattern of any kind can go on: before a character that none has, or between two words.
PIECE = r"(?s).{4000}.*?(?=[^A-Za-z0-9._%+\-@()\[\]{}:\x20]|(?<=[A-Za-z])\x20[A-Za-z])|.+"
SPAN = "struct<start: int, end: int, value: string>"
#: Values of each feature of a span's shape.
SHAPE = (("length", 6), ("digits", 6), ("separators", 5), ("kinds", 4), ("lead", 4), ("before", 5), ("after", 5), ("word", 4), ("place", 3))


def any_of(words: str) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words.split()) + r")(?![\p{L}\p{N}])"


def listed_words(words: str) -> str:
    return r"(?:^|[^\p{L}\p{N}])" + any_of(words)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column) -> Column:
    """A text in pieces that no span crosses: a cut is before a character that no pattern has, or between two words."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def in_context(parts: Column) -> Column:
    """Pieces with their places (in code points) and the text around them; ``parts`` is a column, not an expression."""
    begin = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    around = lambda i, side: F.coalesce(side(F.get(parts, i)), F.lit(""))
    zipped = F.arrays_zip(parts.alias("text"), F.slice(begin, F.lit(1), F.size(parts)).alias("at"))
    return F.transform(zipped, lambda p, i: F.struct(p["at"].alias("at"), p["text"].alias("text"), around(i - 1, lambda t: F.right(t, F.lit(BEFORE))).alias("before"), around(i + 1, lambda t: F.left(t, F.lit(BEHIND))).alias("after")))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points; ``text`` is a piece, which holds few."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, p):
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("out"))

    def placed(found):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        matched = F.zip_with(found, gaps, lambda v, g: F.struct(F.length(g).alias("gap"), v.alias("value")))
        return F.when(F.size(found) > 0, F.aggregate(matched, first, step, lambda acc: acc["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` have a Luhn sum divisible by ten."""
    d = F.reverse(digits(v))

    def add(total, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def passes(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return n.between(13, 19) & luhn(v)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def well_formed(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    return {
        "email": v.rlike(r"[.\]) ][A-Za-z]{2,24}$"),
        "ip": v.contains(":") | ~v.rlike(r"^(?:0|255)\."),
        "card": luhn(v) & ~digits(v).rlike(r"^([0-9])\1+$"),
        "phone": n.between(10, 15),
    }[kind]


def neighbours(text: Column, span: Column) -> tuple[Column, Column, Column, Column]:
    """Lower-cased text before and after a span, and the characters next to it, blanks at the ends."""
    before = F.lower(F.substring(text, F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE))))
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(BEHIND)))
    left = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(" ")
    right = F.substring(text, span["end"] + 1, F.lit(1))
    return before, after, left, F.when(right == "", " ").otherwise(right)


def votes(kind: str, text: Column, span: Column, base: bool) -> Column:
    """The votes on a span as one number in base three: 0 against, 1 none, 2 for."""
    before, after, left, right = neighbours(text, span)
    alone = ~F.concat(left, right).rlike(r"[\p{L}\p{N}_@/=]")
    each = [
        F.lit(2) if base else F.when(passes(kind, span["value"]), 2).otherwise(0),
        F.when(well_formed(kind, span["value"]), 2).otherwise(0),
        F.when(before.rlike(listed_words(GAZETTEER[kind])), 2).otherwise(1),
        F.when(after.rlike(r"^[\s,;(]*" + any_of(AFTER[kind])), 2).otherwise(1),
        F.when(alone, 2).otherwise(0),
        F.when(before.rlike(listed_words(AGAINST) + r"\P{L}*$"), 0).otherwise(1),
    ]
    total = F.lit(0)
    for i, v in enumerate(each):
        total = total + v * 3**i
    return total


def class_of(c: Column) -> Column:
    """Blank, opening or closing mark, letter or digit, anything else."""
    return F.when(c.rlike(r"[\n\r]"), 4).when(c.rlike(r"\s"), 0).when(c.rlike(r"[\p{L}\p{N}_]"), 1).when(c.rlike(r"""[.,;:()\[\]<>"'!?]"""), 2).otherwise(3)


def shape(kind: str, text: Column, span: Column) -> Column:
    """The features of SHAPE as one number."""
    before, _, left, right = neighbours(text, span)
    v = span["value"]
    separators = F.regexp_replace(v, r"[\p{L}\p{N}]", "")
    n, digit, sep = F.length(v), F.length(digits(v)), F.length(separators)
    each = {
        "length": F.least(F.floor(n / 6), F.lit(5)),
        "digits": F.least(F.floor(digit / 4), F.lit(5)),
        "separators": F.least(sep, F.lit(4)),
        "kinds": F.least(F.size(F.array_distinct(F.split(separators, ""))), F.lit(3)),
        "lead": F.when(v.startswith("+"), 1).when(v.startswith("("), 2).when(v.rlike(r"^[A-Za-z]"), 3).otherwise(0),
        "before": class_of(left),
        "after": class_of(right),
        "word": F.when(before.rlike(listed_words(AGAINST) + r"\P{L}*$"), 2).when(before.rlike(r":\s*$"), 3).when(before.rlike(listed_words(GAZETTEER[kind])), 1).otherwise(0),
        "place": F.when(before.rlike(r"(?:^|\n)\s*$"), 0).when(before.rlike(r"\p{L}\s$"), 1).otherwise(2),
    }
    total = F.lit(0).cast("long")
    for name, size in reversed(SHAPE):
        total = total * size + F.greatest(F.least(each[name].cast("int"), F.lit(size - 1)), F.lit(0))
    return total


def candidates(piece: Column, kind: str) -> Column:
    """All candidate spans of a kind in a piece, placed in the whole text: start, end, base, votes, shape."""
    text, lead = piece["text"], F.length(piece["before"])
    none = F.array().cast("array<struct<start: int, end: int, base: boolean, votes: int, shape: bigint>>")

    def judged(spans: Column, base: bool, whole: Column) -> Column:
        def one(s):
            inside = F.struct((s["start"] + lead).alias("start"), (s["end"] + lead).alias("end"), s["value"].alias("value"))
            return let(inside, lambda at: F.struct((piece["at"] + s["start"]).alias("start"), (piece["at"] + s["end"]).alias("end"), F.lit(base).alias("base"), votes(kind, whole, at, base).alias("votes"), shape(kind, whole, at).alias("shape")))

        return F.transform(spans, one)

    strict = F.filter(located(text, BASE[kind]), lambda s: passes(kind, s["value"]))
    both = let(F.concat(piece["before"], text, piece["after"]), lambda whole: F.concat(judged(strict, True, whole), judged(located(text, WIDER[kind]), False, whole)))
    return F.when(text.rlike(NEEDS[kind]), both).otherwise(none)


def estimate(counts: dict[int, int], steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of a kind and their posteriors, by EM of a two-class model with independent labelers."""
    patterns = np.array(sorted(counts), int)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    v = patterns[:, None] // 3 ** np.arange(LABELERS) % 3
    share = 0.5
    # a labeler starts out better than chance; the same pseudo-counts smooth every step
    start = np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])
    p = np.repeat(start[:, None, :], LABELERS, axis=1)
    post = np.full(len(patterns), 0.5)
    for _ in range(steps):
        like = np.log([1 - share, share])[:, None] + np.log(p[:, np.arange(LABELERS)[None], v]).sum(2)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        weight = np.stack([n * (1 - post), n * post])
        share = float((weight[1].sum() + 2) / (n.sum() + 4))
        for c in (0, 1):
            for k in range(LABELERS):
                seen = np.bincount(v[:, k], weight[c], 3) + 10 * start[c]
                p[c, k] = seen / seen.sum()
    return patterns, post


def coded(shapes: np.ndarray) -> np.ndarray:
    """A row a shape: a one for each feature's value, and one for the intercept."""
    columns = [np.ones(len(shapes))]
    rest = shapes.copy()
    for _, size in SHAPE:
        columns += list((rest % size == np.arange(size)[:, None]).astype(float))
        rest //= size
    return np.column_stack(columns)


def train(shapes: np.ndarray, post: np.ndarray, n: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights, the intercept first, of a logistic classifier over the features' values, trained on soft labels."""
    x = coded(shapes)
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.append(1e-3, np.full(len(w) - 1, 1.0)))
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (n * (post - q)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def classified(kind: str, w: np.ndarray):
    """From a candidate to a span with the classifier's score."""

    def scored(s):
        z, at, unit = F.lit(float(w[0])), 1, 1
        for _, size in SHAPE:
            value = (F.floor(s["shape"] / unit) % size).cast("int")
            z = z + F.get(F.array(*[F.lit(float(v)) for v in w[at : at + size]]), value)
            at, unit = at + size, unit * size
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), (1 / (1 + F.exp(-z))).alias("score"))

    return scored


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``src, spans`` per row of ``docs``; ``src`` holds its columns but the text.

    Spans are (kind, start, end, base, score), by kind in the order of KINDS,
    then start; places count code points, the end excluded. Base spans stay
    whatever their score. An added span meets no base span and no other added
    one: of two that meet, the one that starts first stays, of equal starts the
    kind listed first. Null and empty texts have none; repeated rows have the
    same spans each, and count each in the votes; texts are searched whole,
    whatever their length. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).alias("none")]).alias("src"), pieces(text).alias("parts"))
    rows = rows.select("src", in_context(F.col("parts")).alias("parts"))
    by_kind = lambda p: F.struct(*[candidates(p, k).alias(k) for k in KINDS])
    held = F.filter(F.transform("parts", by_kind), lambda c: sum((F.size(c[k]) for k in KINDS[1:]), F.size(c[KINDS[0]])) > 0)
    rows = table(rows.select("src", held.alias("held")))

    # spans of a piece, whatever its kind, with what the estimates need of them
    vote_of = lambda c, k: F.transform(c[k], lambda s: F.struct(F.lit(k).alias("kind"), s["votes"].alias("votes"), s["shape"].alias("shape")))
    counted = rows.select(F.explode("held").alias("c")).select(F.explode(F.concat(*[vote_of(F.col("c"), k) for k in KINDS])).alias("c"))
    # a row a vote pattern and shape that occurs: their number has a bound, whatever the documents
    seen = counted.groupBy("c.kind", "c.votes", "c.shape").count().collect()

    weights = {}
    for kind in KINDS:
        mine = [r for r in seen if r["kind"] == kind]
        w = np.zeros(1 + sum(size for _, size in SHAPE))
        if mine:
            counts: dict[int, int] = defaultdict(int)
            for r in mine:
                counts[r["votes"]] += r["count"]
            patterns, post = estimate(counts)
            of = dict(zip(patterns.tolist(), post))
            w = train(np.array([r["shape"] for r in mine]), np.array([of[r["votes"]] for r in mine]), np.array([float(r["count"]) for r in mine]))
        weights[kind] = w

    by_start = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    kind_type = "struct<kind: string, start: int, end: int, base: boolean, score: double>"
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind_type}>").alias("out"))

    def step(acc, s):
        return F.when(s["start"] >= acc["end"], F.struct(s["end"].alias("end"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)

    def decided(spans):
        """Of a piece's spans, in the order of KINDS, those that stay: spans of two pieces never meet."""
        base = F.filter(spans, lambda s: s["base"])
        free = lambda s: ~s["base"] & (s["score"] >= 0.5) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        # the order of kinds is kept among equal starts
        more = F.array_sort(F.filter(spans, free), by_start)
        return F.concat(base, F.aggregate(more, begin, step, lambda acc: acc["out"]))

    scored = lambda c: F.concat(*[F.transform(c[k], classified(k, weights[k])) for k in KINDS])
    found = rows.select("src", F.transform("held", lambda c: let(scored(c), decided)).alias("held"))
    in_order = [F.flatten(F.transform("held", _sorted_of(k, by_start))) for k in KINDS]
    return found.select("src", F.concat(*in_order).alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _sorted_of(kind: str, order):
    return lambda spans: F.array_sort(F.filter(spans, _of(kind)), order)


def _is(kind: str):
    return lambda c: c == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_personal_data(spark, sf_dir):
    return digest(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    n = [F.size(F.filter(base["kind"], _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("src.doc_id").alias("doc_id"), *n, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def personal_data_base(spark, sf_dir):
    """The base half of op8's result, which SQL can express."""
    return op8_personal_data(spark, sf_dir).drop("spans", "n_spans")


BASE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), matched AS (
  SELECT doc_id, 1 AS nr, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ms, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gs FROM docs
  UNION ALL
  SELECT doc_id, 2, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM docs
  UNION ALL
  SELECT doc_id, 3, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM docs
  UNION ALL
  SELECT doc_id, 4, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM docs
), places AS (
  SELECT doc_id, nr, kind, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
         sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, nr ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, nr, kind, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM matched) u
  WINDOW w AS (PARTITION BY doc_id, nr ORDER BY i)
), kept AS (
  SELECT doc_id, nr, kind, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM places
  WHERE kind = 'email'
     OR kind = 'ip' AND regexp_full_match(m || '.', '(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){4}')
     OR kind = 'phone' AND length(digits) BETWEEN 9 AND 15
     OR kind = 'card' AND length(digits) BETWEEN 13 AND 19
        AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(digits)[i]::INT WHEN reverse(digits)[i]::INT > 4 THEN reverse(digits)[i]::INT * 2 - 9 ELSE reverse(digits)[i]::INT * 2 END)) % 10 = 0
)
SELECT d.doc_id, count(k.kind) FILTER (k.kind = 'email')::BIGINT AS n_email, count(k.kind) FILTER (k.kind = 'ip')::BIGINT AS n_ip, count(k.kind) FILTER (k.kind = 'card')::BIGINT AS n_card, count(k.kind) FILTER (k.kind = 'phone')::BIGINT AS n_phone,
       sha256(coalesce(string_agg(k.kind || ':' || k.start || ':' || k.stop, ',' ORDER BY k.nr, k.start), '')) AS base_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
