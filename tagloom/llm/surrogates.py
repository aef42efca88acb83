r"""Surrogates for personal data and secrets, by DataFrame operations only.

Mentions are found by one pattern; a mention's canonical form (digits of numbers, lower case of the rest) is the
entity, and of a name each word is one, so that "Mrs Anna Schmidt" and "Mrs Schmidt" stay one family. Each entity gets
a surrogate from a keyed digest: digits for digits, letters of the same script, case and kind for letters, valid
octets for addresses, a valid check digit for card numbers; what marks format, country, issuer or a key's kind stays,
and so does a title, and with it the gender, before a name. A name's word keeps its ending, which carries gender.

A surrogate that equals an entity of the corpus, or that two entities share, is drawn again with the next attempt,
until none is left; from each LONGER-th attempt on names, secrets and addresses grow by a letter, so that short ones
don't run out. Distinct stays distinct. All mentions of an entity in all documents get its surrogate, each in the
mention's own format. A name of two words that stands after a title in a text is replaced wherever it stands in that
text; other names without a title aren't found, nor a third word of a name.

The key is KEY_SETTING of the session's configuration, or else a random one, new with each call: then surrogates of
one call can't be had again.

Null texts stay null, and empty texts and those without a mention are unchanged, and so is a mention without a letter
or digit, such as a password in stars. Every row comes back, repeated rows as often as they were, with every column;
one named n_entities is replaced. Texts and secrets may be of any length. An empty table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import concluded, saved, table

KEY_SETTING = "spark.tagloom.surrogate.key"
#: Attempts after which surrogates grow by a letter, and after which something must be wrong.
LONGER, ATTEMPTS = 8, 256
TITLES = "Mr|Mrs|Ms|Miss|Herr|Frau|Señora|Señor|Madame|Monsieur"
SECRETS = "password|passwd|pwd|secret|token|api_key|apikey"
#: What one of these could be in is looked at closely; it is cheaper than PATTERN and never misses a mention.
HINT = rf"[0-9@]|AKIA|[sp]k_(?:live|test)_|ghp_|(?:{TITLES})\.? \p{{Lu}}|(?i:{SECRETS})\s{{0,2}}[=:]"
#: A name's word after its capital.
NAME = r"(?:['’-]?\p{L}){1,40}+"
PATTERN = "|".join([
    rf"(?<=(?i:{SECRETS})\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"',;]{{5,}}[^\s\"',;.]",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\b(?:sk|pk)_(?:live|test)_[0-9A-Za-z]{16,}+\b|\bghp_[0-9A-Za-z]{36}\b",
    r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)",
    rf"(?<=\b(?:{TITLES})\.? )\p{{Lu}}{NAME}(?: \p{{Lu}}{NAME}(?!\p{{N}}))?",
])
FULL_NAME = rf"^\p{{Lu}}{NAME} \p{{Lu}}{NAME}$"
#: Letters that stand for letters of the same script, case and kind (fixed values).
_KINDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áàâäéèêëíìîïóòôöúùûüãõå", "çñß", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
#: Letters for those of other scripts, by script, and for all the rest (fixed values).
_SCRIPTS = {
    "IsHan": "一二三四五六七八九十人大小中上下山川木水火土石田力口目手日月金玉天文心白高長門",
    "IsHiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "IsKatakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "IsHangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
    "IsArabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "IsHebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "IsDevanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "IsThai": "กขคงจชซดตทนบปผพมยรลวสหอ",
    "Lu": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "L": "abcdefghijklmnopqrstuvwxyz",
    "N": "0123456789",
}


def kind_of(mention: str = "mention") -> Column:
    return F.expr(rf"""CASE WHEN {mention} RLIKE '^[^@\\s]+@[^@\\s]+\\.\\p{{L}}+$' THEN 'email'
        WHEN {mention} RLIKE '^AKIA[0-9A-Z]{{16}}$' THEN 'key'
        WHEN {mention} RLIKE '^(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$' THEN 'ip'
        WHEN {mention} RLIKE '^[0-9](?:[ -]?[0-9]){{12,18}}$' THEN 'card'
        WHEN {mention} RLIKE '^[0-9+(][0-9+() .-]{{6,}}$' THEN 'phone'
        WHEN {mention} RLIKE '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{1,4}}){{3,8}}$' THEN 'iban'
        WHEN {mention} RLIKE '^\\p{{Lu}}(?:[\\x27’-]?\\p{{L}})+(?: \\p{{Lu}}(?:[\\x27’-]?\\p{{L}})+)?$' THEN 'name' WHEN {mention} RLIKE '^[0-9a-f]+$' THEN 'hex' ELSE 'secret' END""")


def canonical() -> Column:
    """What makes mentions the same entity: the last ten digits of phones, the digits of cards, no spaces in account numbers, lower case of addresses."""
    return F.expr(r"""CASE WHEN kind = 'phone' THEN right(regexp_replace(mention, '[^0-9]', ''), 10) WHEN kind = 'card' THEN regexp_replace(mention, '[^0-9]', '') WHEN kind = 'iban' THEN replace(mention, ' ', '')
        WHEN kind = 'email' THEN lower(mention) ELSE mention END""")


def _drawn(key: str) -> tuple[Column, Column, Column]:
    """The surrogate of (kind, base) by the digest d, a character drawn for each by its own kind; d for a key and attempt; and base, canon or a longer form of it."""
    # Kept: an issuer's digit, a country, a key's mark, a name's ending, an address' last two labels.
    keep = r"""CASE kind WHEN 'card' THEN i < 1 WHEN 'iban' THEN i < 2 WHEN 'key' THEN i < 4
        WHEN 'name' THEN i = length(base) - 1 WHEN 'email' THEN i >= length(base) - length(regexp_extract(base, '[.@][^.@]+\\.[^.@]+$', 0)) ELSE false END"""
    value = "CAST(conv(substr(d, 2 * (i % 128) + 1, 2), 16, 10) AS INT)"
    by_kind = " ".join(f"WHEN instr('{k}', c) > 0 THEN substr('{k}', {value} % {len(k)} + 1, 1)" for k in _KINDS)
    by_kind = f"WHEN kind = 'hex' THEN substr('abcdef', {value} % 6 + 1, 1) {by_kind} "
    by_kind += " ".join(rf"WHEN c RLIKE '\\p{{{p}}}' THEN substr('{k}', {value} % {len(k)} + 1, 1)" for p, k in _SCRIPTS.items())
    letters = f"array_join(transform(filter(split(base, ''), c -> c <> ''), (c, i) -> CASE WHEN {keep} THEN c WHEN c RLIKE '^[0-9]$' THEN CAST({value} % 10 AS STRING) {by_kind} ELSE c END), '')"
    octets = "array_join(transform(split(base, '[.]'), (o, i) -> CAST(CAST(conv(substr(d, 4 * i + 1, 4), 16, 10) AS INT) % 254 + 1 AS STRING)), '.')"
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), *[F.col(c) for c in order]), 512) for order in (("kind", "attempt", "canon"), ("attempt", "canon", "kind"))])
    more = f"repeat('a', attempt div {LONGER})"
    base = f"CASE kind WHEN 'name' THEN concat(left(canon, length(canon) - 1), {more}, right(canon, 1)) WHEN 'email' THEN concat({more}, canon) WHEN 'secret' THEN concat(canon, {more}) WHEN 'hex' THEN concat(canon, {more}) ELSE canon END"
    return F.expr(f"CASE WHEN kind = 'ip' THEN {octets} ELSE {letters} END"), digest, F.expr(base)


def _checked() -> Column:
    """A card's last digit set so that its check sum is right: every second digit from the end doubled, nines cast out."""
    body = "substr(sur, 1, length(sur) - 1)"
    total = f"aggregate(transform(reverse(filter(split({body}, ''), c -> c <> '')), (c, i) -> IF(i % 2 = 0, IF(2 * CAST(c AS INT) > 9, 2 * CAST(c AS INT) - 9, 2 * CAST(c AS INT)), CAST(c AS INT))), 0, (a, x) -> a + x)"
    return F.expr(f"CASE WHEN kind = 'card' THEN concat({body}, CAST((10 - {total} % 10) % 10 AS STRING)) ELSE sur END")


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, attempt) with sur."""
    sur, digest, base = _drawn(key)
    return entities.withColumn("d", digest).withColumn("base", base).withColumn("sur", sur).drop("d", "base").withColumn("sur", _checked())


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon and sur, one to one, and no sur is a canon of its kind."""
    entities = saved(entities.select("kind", "canon").distinct())
    known = entities.select("kind", F.col("canon").alias("sur"))
    left, done = entities, None
    for attempt in range(ATTEMPTS):
        now = drawn(left.select("kind", "canon", F.lit(attempt).alias("attempt")), key).join(known, ["kind", "sur"], "left_anti")
        if done is not None:
            now = now.join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        # Of those that draw the same, the first keeps it; only the others and those that met a taken one draw again.
        now = saved(now.groupBy("kind", "sur").agg(F.min("canon").alias("canon")).select("kind", "canon", "sur"))
        done = now if done is None else done.unionByName(now)
        left = saved(left.join(now.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if left.isEmpty():
            return done
    raise ValueError("the formats of some entities leave too few surrogates to keep them distinct")


def formatted() -> Column:
    """sur in the format of mention: for phones, cards and account numbers its characters take the places of the mention's, in order.

    A phone's country code, what is before its last ten digits, stays.
    """
    whole = "IF(kind = 'phone', concat(left(regexp_replace(mention, '[^0-9]', ''), greatest(length(regexp_replace(mention, '[^0-9]', '')) - 10, 0)), sur), sur)"
    fill = f"aggregate(filter(split(mention, ''), c -> c <> ''), named_struct('out', '', 'n', 0), (a, c) -> IF(c RLIKE '[0-9A-Za-z]', named_struct('out', concat(a.out, substr({whole}, a.n + 1, 1)), 'n', a.n + 1), named_struct('out', concat(a.out, c), 'n', a.n)), a -> a.out)"
    case = "array_join(transform(filter(split(mention, ''), c -> c <> ''), (c, i) -> IF(c = lower(c), substr(sur, i + 1, 1), upper(substr(sur, i + 1, 1)))), '')"
    return F.expr(f"CASE WHEN kind IN ('phone', 'card', 'iban') THEN {fill} WHEN kind = 'email' AND length(sur) = length(mention) THEN {case} ELSE sur END")


def key_of(spark) -> str:
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


@concluded
def with_surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with every mention in text replaced, and n_entities, the number of mentions that the pattern finds."""
    key = key or key_of(docs.sparkSession)
    none = F.array().cast("array<string>")
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(none)
    columns = [c for c in docs.columns if c != "n_entities"]
    looked = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.coalesce(found, none).alias("_m"))
    looked = saved(looked.withColumn("_row", F.monotonically_increasing_id()))
    mentions = looked.filter("size(_m) > 0").select("_row", F.posexplode("_m").alias("i", "mention"))
    whole = mentions.select("mention").distinct().withColumn("kind", kind_of())
    units = F.expr("if(kind = 'name', split(mention, ' '), array(mention))")
    units = saved(whole.select(F.col("mention").alias("whole"), "kind", F.posexplode(units).alias("u", "mention")).withColumn("canon", canonical()))
    replaceable = F.col("canon").rlike(r"[\p{L}\p{N}]")
    named = units.join(surrogates(units.filter(replaceable), key), ["kind", "canon"], "left").withColumn("new", F.coalesce(formatted(), "mention"))
    named = named.groupBy("whole").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", "new"))), lambda s: s["new"]), " ").alias("new"))
    replaced = mentions.join(named.withColumnRenamed("whole", "mention"), "mention").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("i", "new", "mention"))).alias("_new"))
    parts = F.split(F.col("_doc.text"), PATTERN, -1)
    text = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.get("_new", i)["new"], F.lit("")))), "")
    joined = looked.filter("size(_m) > 0").join(replaced, "_row").withColumn("_parts", parts).select("_doc", text.alias("_text"), F.size("_m").alias("n_entities"), "_new")
    # A full name after a title stands for the same person elsewhere in its text.
    full = F.array_distinct(F.transform(F.filter("_new", lambda s: s["mention"].rlike(FULL_NAME)), lambda s: F.struct(s["mention"].alias("old"), s["new"].alias("new"))))
    again = F.aggregate(full, F.col("_text"), lambda t, s: F.replace(t, s["old"], s["new"]))
    joined = joined.select("_doc", again.alias("_text"), "n_entities")
    same = looked.filter("size(_m) = 0").select("_doc", F.col("_doc.text").alias("_text"), F.lit(0).alias("n_entities"))
    columns = [F.col("_text").alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in columns]
    return same.unionByName(joined).select(*columns, "n_entities")


def op7_surrogates(spark, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
