"""Personal data by bootstrapped contextual extraction, in column expressions only.

Base matchers find mail addresses, IP addresses, payment cards and phone
numbers with their places. These are the seeds; for a fifth kind, secrets, the
seeds are long tokens of small letters and digits that something is set to
(``... =``); what it is that is set isn't listed but learned. A match's
lexical patterns are the word before it, the two words before it and the word
after it; a label such as ``key=`` counts as a word. Tokens that hold a digit
or an @ and lie in no base match are candidates with patterns of the same form.
Over all documents, patterns and instances form a bipartite graph: a pattern is
trusted for a kind as far as its instances are known to be of that kind, an
instance as far as trusted patterns hold it. Trust is the lower end of Wilson's
interval, so that a few instances of one kind by chance make no pattern. After
``rounds`` of this, trusted patterns add their candidates: identifiers that no
base matcher and no seed's form knows, and secrets, which no base matcher looks for. A seed
of the fifth kind is added as well only if a trusted pattern holds it. A hot word or
token is only ever a key of sums taken before the shuffle.

Time is linear in a text's length, even if it is one long run of characters or
holds thousands of matches: matches are tried once per run, and places and
overlaps come from one walk over sorted arrays.

Edge cases: a null or empty text has no spans; a base match that fails its
check is dropped and not tried again inside; base kinds may overlap each other,
added spans overlap no base span; repeated rows get the same spans each; rows
without a doc_id are searched as well; an empty table gives no rows; ``redact``
keeps all columns, whatever their names.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import cut, let, own_names, scan
from .storage import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,kind:int,end:int,patterns:array<string>,token:string>>"
_NEAR = 96  # code points on either side of a match in which its context is looked for

# what may stand before a match: the end of the previous one, or nothing that the match would have begun with
_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# a candidate's label and opening marks, and its closing marks
_HEAD = r"^(?:[\p{L}_-]++[=:])?[^\p{L}\p{N}+]*+"
_TAIL = r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
# the form of a secret's seed, and the pattern that it has if something is set to it
_SECRET = r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9_+/.-]{24,}$"
_SET = r"^< .*=$"


@dataclass(frozen=True)
class PiiParams:
    rounds: int = 3
    #: least trust in a pattern (a lower bound, ``z`` standard errors down), and least number of different known instances that it holds
    confidence: float = 0.75
    z: float = 1.96
    support: int = 4
    #: characters that a candidate has at least
    least_chars: int = 6


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _patterns(before: Column, after: Column) -> Column:
    """The patterns of a place: the word before it, the two words before it, the word after it; as many as there are."""
    words = F.split(F.regexp_replace(F.lower(F.right(before, F.lit(_NEAR))), r"[\s\"'(\[{<]+$", ""), r"\s+")
    right = F.lower(F.regexp_extract(F.left(after, F.lit(_NEAR)), r"^[^\p{L}\p{N}]*(\S+)", 1))

    def made(w: Column) -> Column:
        one, two = F.try_element_at(w, F.lit(-1)), F.try_element_at(w, F.lit(-2))
        return F.array(F.when(one != "", F.concat(F.lit("< "), one)), F.when((one != "") & (two != ""), F.concat(F.lit("< "), two, F.lit(" "), one)), F.when(right != "", F.concat(F.lit("> "), right)))

    return F.array_compact(let(words, made))


def _places(text: Column, found: Column, pattern: str, made) -> Column:
    """What ``made(start, match, text before, text after)`` gives, an array of ``_FOUND``, for all matches of ``pattern`` in ``text``.

    What lies between the matches is split off, and lengths are summed.
    """

    def walked(parts: Column) -> Column:
        pairs = F.zip_with(found, parts, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        items = F.zip_with(pairs, F.slice(parts, 2, F.size(parts)), lambda x, r: F.struct(x["m"].alias("m"), x["p"].alias("p"), r.alias("r")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["p"])
            return F.coalesce(start + F.length(x["m"]), start), F.when(x["m"].isNull(), F.array().cast(_FOUND)).otherwise(made(start, x["m"], x["p"], x["r"]))

        return scan(items, F.lit(0), step, _FOUND)

    return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), walked)).otherwise(F.array().cast(_FOUND))


def _with_matches(docs: DataFrame) -> DataFrame:
    """Add the texts of all matches by kind; a text without a character that the kind needs isn't searched."""
    text = F.col("_text")
    none = F.array().cast("array<string>")
    digit = text.rlike("[0-9]")
    docs = docs.withColumn("_digit", digit)
    find = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return docs.select(
        *(c for c in docs.columns if c != "_digit"),
        F.when(F.contains(text, F.lit("@")), find(_MAIL)).otherwise(none).alias("_email"),
        F.when(F.col("_digit") & F.contains(text, F.lit(".")), find(_IP)).otherwise(none).alias("_ip"),
        F.when(F.col("_digit"), find(_CARD)).otherwise(none).alias("_card"),
        F.when(F.contains(text, F.lit("+")), find(_PHONE)).otherwise(none).alias("_phone"),
        F.when(F.col("_digit") | F.contains(text, F.lit("@")), find(_TOKEN)).otherwise(none).alias("_tokens"),
    )


def _found(start: Column, kind: Column, end: Column, patterns: Column, token: Column) -> Column:
    return F.struct(start.alias("start"), kind.cast("int").alias("kind"), end.alias("end"), patterns.alias("patterns"), token.alias("token"))


def _candidate(p: PiiParams):
    """A token without its label and the marks around it, as an array of one, or of none if too little is left."""

    def made(start: Column, m: Column, before: Column, after: Column) -> Column:
        head = F.regexp_extract(m, _HEAD, 0)
        body = F.regexp_replace(F.substr(m, F.length(head) + 1), _TAIL, "")

        def one(x: Column) -> Column:
            at, token = start + F.length(x["head"]), F.lower(x["body"])
            end = at + F.length(x["body"])
            patterns = _patterns(F.concat(F.right(before, F.lit(_NEAR)), x["head"]), after)
            kind = F.when(x["body"].rlike(_SECRET) & F.exists(patterns, lambda t: t.rlike(_SET)), SECRET)
            return F.when((F.length(x["body"]) >= p.least_chars) & token.rlike("[0-9@]"), F.array(_found(at, kind, end, patterns, token))).otherwise(F.array().cast(_FOUND))

        return let(F.struct(head.alias("head"), body.alias("body")), one)

    return made


def _apart(base: Column, tokens: Column) -> Column:
    """The tokens that overlap no base span: one walk over both, ordered by their starts."""
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("tag"), b["end"].alias("end"), F.lit(None).cast(_FOUND[6:-1]).alias("own")))
    own = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("tag"), t["end"].alias("end"), t.alias("own")))

    def walked(both: Column) -> Column:
        items = F.zip_with(both, F.slice(both, 2, F.size(both)), lambda x, n: F.struct(x.alias("x"), n["start"].alias("start"), n["tag"].alias("tag")))

        def step(far: Column, i: Column) -> tuple[Column, Column]:
            x = i["x"]
            # a base span that starts inside a token is the next item, as tokens don't overlap each other
            free = (x["tag"] == 1) & (far <= x["start"]) & ~F.coalesce((i["tag"] == 0) & (i["start"] < x["end"]), F.lit(False))
            return F.when(x["tag"] == 0, F.greatest(far, x["end"])).otherwise(far), F.when(free, F.array(x["own"])).otherwise(F.array().cast(_FOUND))

        return scan(items, F.lit(0), step, _FOUND)

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(F.sort_array(F.concat(spans, own)), walked))


def _base(docs: DataFrame, p: PiiParams) -> DataFrame:
    """``base``: the seeds in order; ``tokens``: candidates, in no base span. Both with patterns. ``_text`` must be there."""
    text = F.col("_text")
    keep = [c for c in docs.columns]
    out = _with_matches(docs)
    spans = []
    for k, (kind, pattern) in enumerate(zip(BASE_KINDS, (_MAIL, _IP, _CARD, _PHONE), strict=True)):

        def made(start: Column, m: Column, before: Column, after: Column, k=k, kind=kind) -> Column:
            return F.when(_passes(kind, m), F.array(_found(start, F.lit(k), start + F.length(m), _patterns(before, after), F.lower(m)))).otherwise(F.array().cast(_FOUND))

        spans.append(_places(text, F.col(f"_{kind}"), pattern, made))
    out = out.select(*keep, F.sort_array(F.concat(*spans)).alias("base"), _places(text, F.col("_tokens"), _TOKEN, _candidate(p)).alias("tokens"))
    return out.select(*keep, "base", _apart(F.col("base"), F.col("tokens")).alias("tokens"))


def _trusted(instances: DataFrame, p: PiiParams) -> DataFrame:
    """Patterns (pattern, kind, trust) after the last round, from instances (pattern, token, kind; kind null where unknown)."""
    graph = materialize(instances.groupBy("pattern", "token").agg(F.min("kind").alias("kind")), "pii-graph")
    seeds = graph.where("kind is not null").groupBy("token", "kind").agg(F.lit(1.0).alias("score"))
    held = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    share, n, z = F.col("sum") / F.col("n"), F.col("n"), F.lit(p.z)
    wilson = (share + z * z / (2 * n) - z * F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    scores, patterns = seeds, None
    for _ in range(p.rounds):
        known = graph.select("pattern", "token").join(scores, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.sum((F.col("score") >= 0.5).cast("int")).alias("support"))
        known = known.where(F.col("support") >= p.support)
        patterns = known.join(held, "pattern").select("pattern", "kind", wilson.alias("trust"))
        patterns = materialize(patterns.where(F.col("trust") >= p.confidence), "pii-patterns")
        # an instance is doubted only as far as all its patterns are
        doubt = F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.99)))))
        more = graph.where("kind is null").select("pattern", "token").join(patterns, "pattern").groupBy("token", "kind").agg((1 - doubt).alias("score"))
        scores = seeds.unionByName(more.join(seeds.select("token"), "token", "left_anti"))
    return patterns


def _text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _spans(docs: DataFrame, p: PiiParams) -> DataFrame:
    """doc_id, h and g (two hashes of the text), base, spans and unseen (how many of the added spans have no form of a seed) of each row."""
    found = _base(docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_of(docs).alias("_text")), p)
    found = materialize(found.select("doc_id", F.xxhash64("_text").alias("h"), F.hash("_text").alias("g"), "base", "tokens"), "pii-found")
    every = found.where((F.size("tokens") > 0) | (F.size("base") > 0)).select("doc_id", "h", "g", "base", "tokens")
    instances = every.select(F.explode(F.concat("base", "tokens")).alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.token", "x.kind")
    patterns = _trusted(instances, p)
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    found = found.select("doc_id", "h", "g", base.alias("base"))
    if patterns.isEmpty():
        return found.withColumn("spans", F.col("base")).withColumn("unseen", F.lit(0).cast("long"))
    new = every.where(F.size("tokens") > 0).select("doc_id", "h", "g", F.explode("tokens").alias("x"))
    new = new.select("doc_id", "h", "g", "x.start", "x.end", F.col("x.kind").isNull().alias("plain"), F.explode("x.patterns").alias("pattern"))
    added = new.join(patterns, "pattern").groupBy("doc_id", "h", "g", "start", "end").agg(F.max(F.struct("trust", (-F.col("kind")).alias("k"))).alias("best"), F.min("plain").alias("plain"))
    added = added.select("doc_id", "h", "g", F.struct(F.col("start"), (-F.col("best.k")).cast("int").alias("kind"), F.col("end")).alias("span"), "plain")
    added = added.groupBy("doc_id", "h", "g").agg(F.collect_set("span").alias("added"), F.count_if("plain").alias("unseen"))
    added = added.select(F.col("doc_id").alias("a_id"), F.col("h").alias("a_h"), F.col("g").alias("a_g"), "added", "unseen")
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")) & (F.col("g") == F.col("a_g")), "left")
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))
    return joined.select("doc_id", "h", "g", "base", spans.alias("spans"), F.coalesce("unseen", F.lit(0)).cast("long").alias("unseen"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans, written kind:start:end, and how many were added, also without a seed's form."""
    out = _spans(docs, p)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.col("unseen").alias("n_unseen"))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind; overlapping spans are one, of the first's kind."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    kind = "array<struct<start:int,end:int,kind:int>>"

    def before(far: Column, s: Column) -> tuple[Column, Column]:
        """The text before the span; what starts inside an earlier span only moves the end."""
        piece = F.struct(far.alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        return F.greatest(far, s["end"]), F.when(s["start"] >= far, F.array(piece)).otherwise(F.array().cast(kind))

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    joined = let(scan(spans, F.lit(0), before, kind), lambda own: F.array_join(F.zip_with(cut(text, own), own, lambda x, s: F.concat(x, F.get(names, s["kind"]))), ""))
    return F.concat(joined, F.substr(text, end + 1))


def redact(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    own_id, h, g, spans = own_names(docs, "id", "h", "g", "spans")
    found = _spans(docs, p).where(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("h").alias(h), F.col("g").alias(g), F.col("spans").alias(spans)).dropDuplicates([own_id, h, g])
    text = _text_of(docs)
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[own_id]) & (F.xxhash64(text) == found[h]) & (F.hash(text) == found[g]), "left")
    changed = F.col(spans).isNotNull()
    columns = {c: F.col(c) for c in docs.columns} | {"text": F.when(changed, _replaced(F.col("text"), F.col(spans))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*(v.alias(c) for c, v in columns.items()))
