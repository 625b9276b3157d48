"""Personal data replaced by keyed surrogates, with SQL functions only.

Detected entities: e-mail addresses, phone, card and social security numbers,
IPv4 addresses, cloud access keys, long hexadecimal secrets, values assigned to
password-like names, and persons named after a title.

A surrogate is drawn from a keyed hash of the entity's kind and canonical form
(digits only, or lower case), so every mention of an entity gets the same one,
in the format of that mention: letters stay letters of the same case, digits
digits, separators, country codes, key prefixes and top-level domains stay, card
numbers keep their Luhn remainder, names keep title, gender and script. A check
over all entities of the corpus then redraws any surrogate that two entities
share or that some entity really has, until all are distinct.

Only texts with entities meet a shuffle, by the hash of the text, so copies are
worked on once. Null texts stay null, texts without entities are unchanged, and
every input row and column stays; names that start with ``_pii`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentflow.session import stage

# Titles by gender, and the syllables and endings of made-up names.
TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
TITLES_M = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
TITLES_X = ("Dr", "Prof")
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha he ka ke ko la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se so ta te to va ve vi wa we wi".split(),
    "cyrillic": "ба бе во да де до ва ве ви га го за зе ка ке ко ла ле ли ло ма ме ми мо на не но па пе по ра ре ри ро са се со та те то".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε πο ρα ρε ρι ρο σα σε σο τα τε το".split(),
}
ENDINGS = {
    "latin": {"f": "na", "m": "n", "x": "l", "family": "mer"},
    "cyrillic": {"f": "на", "m": "н", "x": "л", "family": "ко"},
    "greek": {"f": "να", "m": "νος", "x": "λ", "family": "λης"},
}

_TITLES = "|".join((*TITLES_F, *TITLES_M, *TITLES_X))
# One part of a name, with hyphens and apostrophes, or an initial before another part.
_PART = rf"(?:(?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}+|(?=['’]\p{{L}}{{2}}))(?:['’-]\p{{L}}{{2,}})*+|\p{{Lu}}\.(?= \p{{Lu}}))"
_ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api_key)[\"']? {0,2}[=:]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"(?:(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
        r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
        r"|(?<![0-9A-Za-z.-])(?:[0-9][.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]))"
    ),
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5})(?![0-9A-Za-z])",
    "secret": (
        r"(?:(?<![A-Za-z0-9])(?=[a-f]{0,40}[0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])"
        rf"|(?<={_ASSIGNED} {{0,2}}[\"']?)[^\s\"']{{6,}})"
    ),
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.?(?: {_PART})++",
}
PATTERN = "|".join(KINDS.values())
# Any entity holds a digit, an at sign, a title, or follows an assignment.
_MAYBE = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}|{_ASSIGNED}"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(value: str) -> str:
    tests = " ".join(
        f"WHEN {value} RLIKE {_quoted('^(?:' + KINDS[k] + ')$')} THEN '{k}'"
        for k in KINDS if k != "secret"
    )
    return f"CASE {tests} ELSE 'secret' END"


def _canonical(kind: str, value: str) -> str:
    """What mentions of one entity share."""
    return (
        f"CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN regexp_replace({value}, '[^0-9]', '') "
        f"WHEN {kind} IN ('email', 'person') THEN lower({value}) ELSE {value} END"
    )


def _draw(key: str, place: str, salt: str = "''") -> str:
    """A keyed number below 65536 for one place of the entity."""
    text = f"concat_ws('|', {_quoted(key)}, _kind, _canon, _try, {salt}, {place} div 16)"
    return f"cast(conv(substr(sha2({text}, 256), cast(({place} % 16) * 4 + 1 as int), 4), 16, 10) as bigint)"


def _luhn(digits: str) -> str:
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> if(i % 2 = 0, cast(d as int), "
        f"cast(d as int) * 2 - if(cast(d as int) > 4, 9, 0))), 0, (a, d) -> a + d) % 10"
    )


def _name(key: str, part: str, role: str) -> str:
    """A made-up name for one lower-case name part, in its script and letter case."""
    own = f"concat_ws('|', {_quoted(key)}, {role}, {part}, _try)"

    def made(script: str) -> str:
        table = "array(" + ", ".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        n = len(SYLLABLES[script])
        syllable = [
            f"element_at({table}, cast(cast(conv(substr(sha2({own}, 256), {1 + 6 * k}, 6), 16, 10) as bigint) % {n} + 1 as int))"
            for k in range(3)
        ]
        ending = " ".join(f"WHEN '{r}' THEN '{e}'" for r, e in ENDINGS[script].items())
        return f"initcap(concat({', '.join(syllable)}, CASE {role} {ending} END))"

    name = (
        f"CASE WHEN {part} RLIKE '\\\\p{{IsCyrillic}}' THEN {made('cyrillic')} "
        f"WHEN {part} RLIKE '\\\\p{{IsGreek}}' THEN {made('greek')} ELSE {made('latin')} END"
    )
    # An initial stays one.
    return f"if({part} RLIKE '^\\\\p{{L}}\\\\.$', concat(substr({name}, 1, 1), '.'), {name})"


def _forms(key: str) -> tuple[str, str, str]:
    """SQL over ``_value``, ``_kind``, ``_canon`` and ``_try``: the surrogate in the same
    form, the one of an address, and the gender of a title."""
    before = (
        "CASE _kind WHEN 'phone' THEN length(regexp_extract(_value, '^(\\\\+[0-9]{1,3}(?=[^0-9])|[0-9](?=([.-][0-9]{3}){2}))', 0)) "
        "WHEN 'key' THEN 4 WHEN 'card' THEN 1 ELSE 0 END"
    )
    after = "if(_kind = 'email', length(regexp_extract(_value, '\\\\.\\\\p{L}+$', 0)), 0)"
    place = "cast(length(regexp_replace(substr(_value, 1, i), '[^\\\\p{L}\\\\p{N}]', '')) as bigint)"
    draw = _draw(key, place)
    hexes = "_value RLIKE '^[0-9a-f]+$'"
    same_form = (
        f"array_join(transform(split(_value, ''), (c, i) -> CASE "
        f"WHEN i < {before} OR i >= length(_value) - {after} THEN c "
        f"WHEN c RLIKE '[0-9]' THEN cast({draw} % 10 as string) "
        f"WHEN c RLIKE '\\\\p{{Lu}}' THEN chr(65 + {draw} % 26) "
        f"WHEN c RLIKE '\\\\p{{L}}' THEN chr(97 + {draw} % if({hexes}, 6, 26)) ELSE c END), '')"
    )
    ip = f"array_join(transform(sequence(0L, 3L), i -> cast(1 + {_draw(key, 'i')} % 254 as string)), '.')"
    gender = (
        f"CASE WHEN _title IN ({', '.join(_quoted(t) for t in TITLES_F)}) THEN 'f' "
        f"WHEN _title IN ({', '.join(_quoted(t) for t in TITLES_M)}) THEN 'm' ELSE 'x' END"
    )
    return same_form, ip, gender


def _surrogate(rows: DataFrame, key: str) -> DataFrame:
    """Add ``_new``, the surrogate of every ``_value``."""
    same_form, ip, gender = _forms(key)
    number = "regexp_replace({}, '[^0-9]', '')"
    zeroed = "concat(substr(_new, 1, length(_new) - 1), '0')"
    last = (
        f"(10 + {_luhn(number.format('_value'))} - {_luhn(number.format(zeroed))}) % 10"
    )
    out = (
        rows.withColumn("_title", F.expr("regexp_extract(_value, '^\\\\p{L}+', 0)"))
        .withColumn("_new", F.expr(f"if(_kind = 'ip', {ip}, {same_form})"))
        .withColumn("_new", F.expr(
            f"if(_kind = 'card', concat(substr(_new, 1, length(_new) - 1), cast({last} as string)), _new)"
        ))
    )
    parts = "split(regexp_extract(_value, '^\\\\p{L}+\\\\.? (.*)$', 1), ' ')"
    head = "regexp_extract(_value, '^(\\\\p{L}+\\\\.? ).*$', 1)"
    named = f"""concat({head}, array_join(transform({parts}, (p, i) ->
        if(i = size({parts}) - 1, {_name(key, 'lower(p)', "'family'")}, {_name(key, 'lower(p)', '_gender')})), ' '))"""
    return (
        out.withColumn("_gender", F.expr(gender))
        .withColumn("_new", F.expr(f"if(_kind = 'person', {named}, _new)"))
        .drop("_title", "_gender")
    )


def _maybe(text: Column) -> Column:
    return F.coalesce(text.rlike(_MAYBE) & text.rlike(PATTERN), F.lit(False))


def _matches(text: str = "text") -> Column:
    return F.expr(f"regexp_extract_all({text}, {_quoted(PATTERN)}, 0)")


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per distinct text with entities and place: _key, _place, _kind, _value, _canon."""
    texts = docs.select(F.col(text).alias("_text")).filter(_maybe(F.col("_text")))
    found = (
        texts.select(F.sha2("_text", 256).alias("_key"), _matches("_text").alias("_all"))
        .dropDuplicates(["_key"])
        .select("_key", F.posexplode("_all").alias("_place", "_value"))
    )
    return found.withColumn("_kind", F.expr(_kind("_value"))).withColumn("_canon", F.expr(_canonical("_kind", "_value")))


def entities(found: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Distinct (_kind, _canon) with ``_try``: the draw that collides with nothing.

    Of entities that draw the same surrogate the smallest keeps it; a surrogate
    that is itself an entity of the corpus is drawn again. The driver sees counts.
    """
    now = stage(
        found.groupBy("_kind", "_canon").agg(F.min("_value").alias("_value"), F.lit(0).alias("_try")),
        "pii-entities",
    )
    for _ in range(most):
        drawn = _surrogate(now, key).withColumn("_drawn", F.expr(_canonical("_kind", "_new")))
        first = drawn.groupBy("_kind", "_drawn").agg(F.min("_canon").alias("_first"))
        real = now.select("_kind", F.col("_canon").alias("_drawn")).withColumn("_real", F.lit(True))
        checked = stage(
            drawn.join(first, ["_kind", "_drawn"]).join(real, ["_kind", "_drawn"], "left").select(
                "_kind", "_canon", "_value", "_try",
                (F.col("_real").isNotNull() | (F.col("_canon") != F.col("_first"))).alias("_again"),
            ),
            "pii-entities",
        )
        now = checked.withColumn("_try", F.col("_try") + F.col("_again").cast("int")).drop("_again")
        if not checked.filter("_again").limit(1).count():
            return now
    raise RuntimeError(f"surrogates still collide after {most} draws: too many entities for their format")


def replace(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """The input with entities of ``text`` replaced; ``found`` names a count column."""
    said = stage(mentions(docs, text), "pii-mentions")
    table = entities(said, key).select("_kind", "_canon", "_try")
    new = stage(
        _surrogate(said.join(table, ["_kind", "_canon"]), key)
        .groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_place", "_new"))).alias("_news"))
        .select(F.col("_key").alias("_pii_found"), F.transform("_news", lambda x: x["_new"]).alias("_pii_news")),
        "pii-surrogates",
    )
    columns = [c for c in docs.columns if c != found]
    plain = docs.filter(~_maybe(F.col(text))).select(*columns, F.lit(0).cast("bigint").alias("_pii_n"))
    rest = docs.filter(_maybe(F.col(text))).withColumn("_pii_key", F.sha2(text, 256))
    joined = rest.join(new, F.col("_pii_key") == F.col("_pii_found")).withColumn(
        "_pii_parts", F.split(F.col(text), PATTERN, -1)
    )
    woven = F.array_join(
        F.zip_with("_pii_parts", "_pii_news", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    changed = joined.select(
        *[woven.alias(c) if c == text else c for c in columns],
        F.size("_pii_news").cast("bigint").alias("_pii_n"),
    )
    out = plain.unionByName(changed)
    return out.withColumnRenamed("_pii_n", found) if found else out.drop("_pii_n")
