"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are the base spans (strict patterns, see BASE) and loose spans (numbers
written like telephone numbers, social security numbers, IBANs, spelled-out mail
addresses, secrets given to a named key) that overlap no base span.  Five labelers vote
on each candidate, +1 (personal), -1 (not) or 0 (no opinion): its shape (regex), two
gazetteers (domains and the lengths of countries' IBANs; numbers known to be nobody's,
and IBANs whose check digits fail), the words before it (context), and its
company (other personal data in the document).  Expectation-maximisation over
the counts of vote patterns, of all candidates of the corpus, estimates each
labeler's reliability and the share of personal spans, without labels.  Each
candidate then has a probability; with these as weights, a final classifier (naive
Bayes over kind, length, punctuation, the votes) is trained and decides which loose spans are added.
Base spans always stay.

Vote patterns and feature values are finite sets (at most 3^5 patterns of 9 kinds,
a few lengths), so what reaches the driver is bounded whatever the corpus.

Offsets are code points, end exclusive.  A match's offset is the sum of the lengths
of the gaps and matches before it, summed piece by piece, and overlaps are looked for
between neighbours in order, so a text of very many matches takes time almost in
proportion to their number.  The patterns are the contract's, in forms that
Java evaluates in linear time and without recursion: possessive repeats, and starts
only where a run of the first class starts or the last match ended.

Defined results: null text counts as empty; no match gives counts 0, the hash of the
empty string and empty spans; rows are independent, so repeated rows are each returned;
very long texts are searched whole; an empty table gives no rows; further columns are
ignored; spans that start together stand longest first among loose ones, and the first stays.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, table, written

#: The base kinds' patterns, in the order of the contract, with a cheap test that a text can match.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", "text rlike '[0-9][.][0-9]'"),
    "card": (r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", "text rlike '[0-9][0-9 -]{15}'"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "contains(text, '+')"),
}
#: Looser patterns, candidates of the labelers.
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}+(?: ?[(\[](?:dot|DOT)[)\]] ?[A-Za-z0-9-]{1,63}+)++", "text rlike '[(\\\\[](at|AT)[)\\\\]]'"),
    "phone": (r"(?<![0-9A-Za-z+.,:/#_-])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9A-Za-z])(?![.,:/_-][0-9])", "text rlike '[0-9]{3}[ .-][0-9]{3}'"),
    "ssn": (r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "text rlike '[0-9]-[0-9]{2}-[0-9]'"),
    "secret": (r"(?<![0-9A-Za-z_])(?:token|secret|password|passwd|pwd|api_?key|access_?key|auth)[\"']?(?: ?[:=]{1,2} ?)[\"']?[0-9A-Za-z_+/.-]{12,512}+=*", "text rlike '(token|secret|passw|pwd|key|auth)[\"\\']? ?[:=]'"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "text rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'"),
}
#: Gazetteers.  Top-level domains: the generic ones in wide use, and the two-letter codes of countries.
DOMAINS = (
    "com|net|org|edu|gov|mil|int|info|biz|name|pro|mobi|coop|museum|aero|jobs|tel|travel|app|dev|io|ai|me|tv|cc|co|online|site|store|shop|tech|cloud|blog|email|xyz|"
    "ac|ad|ae|af|al|am|ao|ar|at|au|az|ba|bd|be|bg|bh|bo|br|by|ca|ch|ci|cl|cm|cn|cr|cu|cy|cz|de|dk|do|dz|ec|ee|eg|es|et|eu|fi|fr|ge|gh|gr|gt|hk|hn|hr|hu|id|ie|il|in|iq|ir|is|it|"
    "jm|jo|jp|ke|kh|kr|kw|kz|lb|li|lk|lt|lu|lv|ly|ma|mc|md|mg|mk|mm|mn|mt|mu|mx|my|mz|na|ng|ni|nl|no|np|nz|om|pa|pe|ph|pk|pl|pr|ps|pt|py|qa|ro|rs|ru|rw|sa|sd|se|sg|si|sk|sn|sv|sy|"
    "th|tj|tm|tn|tr|tt|tw|tz|ua|ug|uk|us|uy|uz|ve|vn|ye|za|zm|zw"
)
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Numbers that are nobody's (area codes never given out, numbers of films and of examples, runs of one digit, years).
NOBODY = r"^\(?(000|555|123)\)?[ .-](000|555|123|1234)|^\(?[0-9]{3}\)?[ .-]555[ .-]01[0-9]{2}$|^(000|666|9[0-9]{2})-[0-9]{2}-|^[0-9]{3}-00-|-0000$|^(078-05-1120|219-09-9999|123-45-6789)$|^(19|20)[0-9]{2}[ .-](19|20)[0-9]{2}|^\(?([0-9])\1+\)?(?:[ .-]\1+)+$"
#: Words that stand before personal data, and before numbers that are none (English, German, French, Spanish, Italian, Portuguese, Dutch).
FOR = (
    r"\b(e-?mails?|mail|correo|courriel|phone|tel|telephone|telefon|telefoon|telefone|telefono|tel[eé]fono|t[eé]l[eé]phone|call|fax|mobile|mobil|cell|cellulare|handy|m[oó]vil|portable|contact|contacts|kontakt|contacto|contatto|"
    r"ssn|social security|sozialversicherung|s[eé]curit[eé] sociale|seguro social|iban|bic|konto|kontonummer|account|compte|cuenta|conto|conta|rekening|bank|card|karte|kreditkarte|carte|tarjeta|carta|visa|mastercard|amex|"
    r"ip|address|adresse|direcci[oó]n|indirizzo|whatsapp|signal|telegram|sms|reach|ring|rufen|anrufen|appelez|llame|chiamare|token|secret|password|passwort|credential|credentials|api)\b[^\n]{0,16}$"
)
AGAINST = (
    r"\b(isbn|issn|doi|version|page|pages|seite|seiten|p[aá]gina|pagina|order|bestellung|commande|pedido|invoice|rechnung|facture|factura|vol|volume|band|no|nr|num|number|ticket|issue|rfc|section|abschnitt|chapter|kapitel|chapitre|"
    r"cap[ií]tulo|figure|fig|abbildung|table|tabelle|tabla|score|result|grant|patent|line|zeile|ligne|row|item|part|sku|serial|build|release|lot|ean|upc|zip|plz|commit|sha|md5|checksum|hash|revision)\b[^\n]{0,8}$"
)
BEFORE = 40
VOTERS = ("shape", "names", "numbers", "words", "company")
FEATURES = ("kind", "size", "marks", *VOTERS)
ROUNDS = 60

SPAN = "struct<kind:string,start:int,stop:int,value:string,before:string>"


def _sql(text: str) -> str:
    """A SQL literal of any text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Elements folded one after another: a fold copies what it has built, so a long array is folded piece by piece.
PIECE = 64


def folded(array: str, merge: str, first: str = "0") -> str:
    """SQL of the array of int whose element k is `merge` (of {a} and x) over the elements before k of an array of int, from `first`."""
    step = f"(s, x) -> struct(({merge.format(a='s.at')}) as at, concat(s.held, array(s.at)) as held)"
    none = "cast(array() as array<int>) as held"
    pieces = f"transform(sequence(0, cast(size(y) / {PIECE} as int)), k -> slice(y, k * {PIECE} + 1, {PIECE}))"
    begins = f"aggregate(transform(p, z -> aggregate(z, {first}, (a, x) -> {merge.format(a='a')})), struct({first} as at, {none}), {step}, s -> s.held)"
    each = f"aggregate(z, struct(o as at, {none}), {step}, s -> s.held)"
    # transform over one element names a value that is used twice
    return f"transform(array({array}), y -> transform(array({pieces}), p -> flatten(zip_with(p, {begins}, (z, o) -> {each})))[0])[0]"


def spans(kind: str, pattern: str, guard: str, keep: str = "true") -> str:
    """SQL of the array of a pattern's matches in `text` for which keep (of x.h, the match) holds, with the characters since the match before (BEFORE at most).

    A match begins after the lengths of all gaps and matches before it.
    """
    p = _sql(pattern)
    found = f"zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (g, h) -> struct(length(g) as g, h as h, right(g, {BEFORE}) as before))"
    sized = "transform(found, x -> x.g + coalesce(length(x.h), 0))"
    placed = f"zip_with(found, {folded(sized, '{a} + x')}, (x, at) -> struct(x.h as h, at + x.g as start, x.before as before))"
    told = f"transform(filter({placed}, x -> x.h is not null and ({keep})), x -> struct('{kind}' as kind, x.start as start, x.start + length(x.h) as stop, x.h as value, lower(x.before) as before))"
    return f"case when {guard} then transform(array({found}), found -> {told})[0] else cast(array() as array<{SPAN}>) end"


_DIGITS = "regexp_replace(x.h, '[^0-9]', '')"
_TWICE = "cast(substring(reverse({d}), i, 1) as int)"
LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + case when i % 2 = 1 then {_TWICE.format(d=_DIGITS)} "
    f"else 2 * {_TWICE.format(d=_DIGITS)} - case when {_TWICE.format(d=_DIGITS)} > 4 then 9 else 0 end end) % 10 = 0"
)
#: Remainder of an IBAN's number: its first four characters last, letters as 10 to 35, taken modulo 97 sign by sign.
MOD97 = (
    "aggregate(split(concat(substring(replace({v}, ' ', ''), 5), substring({v}, 1, 4)), ''), 0, (a, c) -> case when c rlike '[0-9]' then (a * 10 + cast(c as int)) % 97 "
    "when c = '' then a else (a * 100 + ascii(c) - 55) % 97 end)"
)
KEEP = {
    "email": "true",
    "ip": "x.h rlike '^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]|$)){4}$'",
    "card": LUHN,
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose (arrays of spans, with the words before them) of every document; no shuffle."""
    slim = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    base = slim.select("doc_id", "text", *[F.expr(spans(k, p, g, KEEP[k])).alias(k) for k, (p, g) in BASE.items()], *[F.expr(spans(k, p, g)).alias(f"loose_{k}") for k, (p, g) in LOOSE.items()])
    joined = base.select("doc_id", "text", F.concat(*BASE).alias("base"), F.concat(*[f"loose_{k}" for k in LOOSE]).alias("loose"))
    # in order of their starts, a span overlaps an earlier one if it begins before the last stop so far, and a later base span if that begins before its stop;
    # of loose spans that overlap each other, the one that starts first (then the longest, then by kind) stays
    ranked = joined.withColumn("spans", F.expr("array_sort(concat(transform(base, x -> struct(x.start as start, -x.stop as stop, true as base, x.kind as kind, x.value as value, x.before as before)), transform(loose, x -> struct(x.start as start, -x.stop as stop, false as base, x.kind as kind, x.value as value, x.before as before))))"))
    stops, starts = "transform(spans, x -> -x.stop)", "transform(reverse(spans), x -> case when x.base then x.start else 2147483647 end)"
    clear = f"zip_with(zip_with(spans, {folded(stops, 'greatest({a}, x)')}, (x, e) -> struct(x as x, e as e)), reverse({folded(starts, 'least({a}, x)', '2147483647')}), (y, n) -> struct(y.x as x, y.e <= y.x.start and n >= -y.x.stop as clear))"
    kept_ = f"case when size(loose) = 0 then loose else transform(filter({clear}, y -> y.clear and not y.x.base), y -> struct(y.x.kind as kind, y.x.start as start, -y.x.stop as stop, y.x.value as value, y.x.before as before)) end"
    free = ranked.withColumn("loose", F.expr(kept_)).drop("spans")
    return free.select("doc_id", "base", "loose")


def votes(x: str, base: str) -> str:
    """SQL of the struct of a candidate's features; base: whether it is a base span (SQL)."""
    digits = f"length(regexp_replace({x}.value, '[^0-9]', ''))"
    shape = (
        f"case when {base} or {x}.kind = 'email' or {x}.value rlike '^[(][0-9]+[)]|-.*-' then 1 when {x}.kind = 'secret' then case when {x}.value rlike '[0-9].*[0-9]' then 1 else -1 end "
        f"when {x}.kind = 'iban' then case when {x}.value rlike '[0-9]{{4}}' then 1 else -1 end when {x}.value rlike '^[0-9]+ [0-9]+ [0-9]+$' then -1 else 0 end"
    )
    lengths = "map(" + ", ".join(f"'{k}', {n}" for k, n in IBAN_LENGTHS.items()) + ")"
    names = (
        f"case when {x}.kind = 'email' and lower({x}.value) rlike {_sql(rf'[^a-z]({DOMAINS})$')} then 1 "
        f"when {x}.kind = 'iban' then case when try_element_at({lengths}, substring({x}.value, 1, 2)) = length(replace({x}.value, ' ', '')) then 1 else -1 end else 0 end"
    )
    numbers = (
        f"case when {x}.kind = 'iban' then case when {MOD97.format(v=f'{x}.value')} = 1 then 1 else -1 end when {x}.value rlike {_sql(NOBODY)} then -1 "
        f"when {x}.kind in ('phone', 'card', 'ssn') and {digits} between 9 and 19 then 1 else 0 end"
    )
    words = f"case when {x}.before rlike {_sql(FOR)} then 1 when {x}.before rlike {_sql(AGAINST)} then -1 when {x}.kind = 'secret' and {x}.value rlike '[:=]' then 1 else 0 end"
    company = "case when n_base >= 2 or (n_base = 1 and not (%s)) then 1 else 0 end" % base
    return (
        f"struct({x}.kind as kind, case when {digits} = 0 then 0 when {digits} <= 8 then 1 when {digits} <= 12 then 2 else 3 end as size, "
        f"case when {x}.value rlike '[(]' then 2 when {x}.value rlike '[. -]' then 1 else 0 end as marks, "
        f"{shape} as shape, {names} as names, {numbers} as numbers, {words} as words, {company} as company)"
    )


def judged(found: DataFrame) -> DataFrame:
    """Candidates with their features."""
    n = found.withColumn("n_base", F.size("base"))
    with_features = "transform({a}, x -> struct(x.kind as kind, x.start as start, x.stop as stop, {v} as f))"
    return n.select(
        "doc_id",
        F.expr(with_features.format(a="base", v=votes("x", "true"))).alias("base"),
        F.expr(with_features.format(a="loose", v=votes("x", "false"))).alias("loose"),
    )


def expectation_maximisation(counts: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Share of personal spans, each labeler's chance of each vote for (not, personal), and each pattern's probability of being personal.

    Begins at the votes' majority; a labeler's chances are smoothed by one vote of each sort.
    """
    chance = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in counts]
    total = sum(n for _, n in counts)
    share, reliable = 0.5, []
    for _ in range(rounds):
        mass = sum(c * n for c, (_, n) in zip(chance, counts, strict=True))
        share = (mass + 1) / (total + 2)
        reliable = []
        for k in range(len(VOTERS)):
            table_ = {}
            for vote in (-1, 0, 1):
                yes = sum(c * n for c, (v, n) in zip(chance, counts, strict=True) if v[k] == vote)
                no = sum((1 - c) * n for c, (v, n) in zip(chance, counts, strict=True) if v[k] == vote)
                table_[vote] = ((no + 1) / (total - mass + 3), (yes + 1) / (mass + 3))
            reliable.append(table_)
        chance = []
        for v, _ in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(reliable[k][x][1] / reliable[k][x][0]) for k, x in enumerate(v))
            chance.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
    return share, reliable, chance


def classifier(rows: list[dict]) -> tuple[float, dict[str, dict]]:
    """Bias and weight (log odds) of each feature's value, trained on the candidates' probabilities by expectation-maximisation."""
    patterns: dict[tuple[int, ...], float] = {}
    for r in rows:
        v = tuple(r[k] for k in VOTERS)
        patterns[v] = patterns.get(v, 0.0) + r["n"]
    counts = sorted(patterns.items())
    if not counts:
        return 0.0, {}
    _, _, chance = expectation_maximisation(counts)
    belief = dict(zip((v for v, _ in counts), chance, strict=True))
    yes = sum(belief[tuple(r[k] for k in VOTERS)] * r["n"] for r in rows)
    total = sum(r["n"] for r in rows)
    weights: dict[str, dict] = {}
    for f in FEATURES:
        values = {r[f] for r in rows}
        pairs = {}
        for value in values:
            own = [r for r in rows if r[f] == value]
            p = sum(belief[tuple(r[k] for k in VOTERS)] * r["n"] for r in own)
            q = sum(r["n"] for r in own) - p
            pairs[value] = math.log((p + 1) / (yes + len(values))) - math.log((q + 1) / (total - yes + len(values)))
        weights[f] = pairs
    return math.log((yes + 1) / (total - yes + 1)), weights


def score(bias: float, weights: dict[str, dict]) -> str:
    """SQL of a candidate x's log odds."""
    parts = [f"{bias!r}D"]
    for f, pairs in weights.items():
        cases = " ".join(f"when x.f.{f} = {_sql(v) if isinstance(v, str) else v} then {w!r}D" for v, w in sorted(pairs.items(), key=lambda z: str(z[0])))
        parts.append(f"case {cases} else 0D end")
    return " + ".join(parts)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, stop) of every document."""
    found = judged(written(candidates(docs), "pii"))
    each = found.select(F.explode(F.concat("base", "loose")).alias("x")).select("x.f.*").groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"))
    bias, weights = classifier([r.asDict() for r in each.collect()])
    plain = "transform({a}, x -> struct(x.kind as kind, x.start as start, x.stop as stop))"
    added = f"filter(loose, x -> {score(bias, weights)} > 0)" if weights else "slice(loose, 1, 0)"
    return found.select("doc_id", F.expr(plain.format(a="base")).alias("base"), F.expr(plain.format(a=added)).alias("added"))


def rendered(spans_: str) -> F.Column:
    """kind:start:end, by kind in the contract's order (then further kinds by name), then start, comma-joined."""
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(BASE))
    keyed = f"array_sort(transform({spans_}, x -> struct(case x.kind {order} else {len(BASE)} end as o, x.kind as kind, x.start as start, x.stop as stop)))"
    return F.expr(f"array_join(transform({keyed}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(rendered("base").cast("binary"), 256).alias("base_sha256"),
        rendered("concat(base, added)").alias("spans"),
        F.expr("cast(size(base) + size(added) as bigint)").alias("n_spans"),
    )
