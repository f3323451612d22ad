"""Personal data replaced by keyed surrogates.

Entities are found with one regular expression and brought to a canonical form, so that
writings of one thing share it.  The surrogate depends only on the key, the type, the
canonical form and the number of draws: letters become letters of the same script,
digits become digits, separators stay; a name keeps its title and a given name its
gender; an address stays an address; a card number that passes the Luhn test gets one
that does.  All distinct entities are checked against each other and against the
originals, and those that collide draw again: different entities stay different, and
equal ones stay equal in every document (the words of names one by one, so a surname is
the same with and without its given name).

Everything is DataFrame code.  Texts without an entity are passed through where they
are read; texts with one are written to the shared folder once.  Entities are
aggregated before they are shuffled, so a frequent one costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import shared_path, without, written

# Patterns of the entity types, in the order in which they are tried.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MALE_TITLES = "Mr|Herr|Herrn|Monsieur|Señor|Sr|Don"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Srta|Doña"
TYPES = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "card": r"[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![\p{L}\p{N}])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|\+[0-9]{9,14}"
             r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "secret": r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{48}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})(?![\p{L}\p{N}])",
    "name": rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|Dr|Prof)\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}(?![\p{{L}}\p{{N}}])",
}
#: An entity starts where no letter or digit precedes (nor a sign that would belong to it).
ANY = r"(?<![\p{L}\p{N}_%+])(?<![0-9]\.)(?:" + "|".join(TYPES.values()) + ")"
_SCRIPTS = {"[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}
_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwz", "aeiou"
_MAX_DRAWS = 64


def type_of(entity: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(list(TYPES.items())[:-1]):
        out = F.when(entity.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return out


def _gender(entity: Column) -> Column:
    return (F.when(entity.rlike(rf"\A(?:{MALE_TITLES})\.? "), "_m").when(entity.rlike(rf"\A(?:{FEMALE_TITLES})\.? "), "_f").otherwise(""))


def _words(entity: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(entity, r"\A\p{L}+\.? ", "")), "[ -]")


def parts(kind: Column, entity: Column) -> Column:
    """``array<struct<kind, canon>>``: a name's words, or the one canonical form of anything else."""
    words = _words(entity)
    of_name = F.transform(words, lambda w, k: F.struct(
        F.when((k == 0) & (F.size(words) > 1), F.concat(F.lit("given"), _gender(entity))).otherwise(F.lit("surname")).alias("kind"), w.alias("canon")))
    canon = F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(entity, "[^0-9]", "")).otherwise(F.lower(entity))
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _draw(salt: Column, k: Column, n: int) -> Column:
    """The k-th number below n of the salt's hex digits, which are gone round with an offset."""
    return ((F.conv(F.substring(salt, F.pmod(k * 5, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + k * 7) % n).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number + 1, F.lit(1))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The ``attempt``-th surrogate of a canonical form, itself in canonical form.

    Same length and kinds of characters; names get a letter longer every eighth draw.
    """
    salt = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"), F.lit(key)), 256)

    def char(c: Column, k: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", _draw(salt, k, 10)))
        for script, letters in _SCRIPTS.items():
            out = out.when(c.rlike(script), _pick(letters, _draw(salt, k, len(letters))))
        return out.otherwise(c)

    def spoken(c: Column, k: Column) -> Column:  # Latin names alternate consonants and vowels
        latin = F.when(k % 2 == 0, _pick(_CONSONANTS, _draw(salt, k, len(_CONSONANTS)))).otherwise(_pick(_VOWELS, _draw(salt, k, len(_VOWELS))))
        return F.when(c.rlike("[а-яёα-ω]"), char(c, k)).otherwise(latin)

    def shape(text: Column, one=char) -> Column:
        return F.array_join(F.transform(F.split(text, ""), one), "")

    name = shape(F.concat(canon, F.repeat(F.substring(canon, 1, 1), (attempt / 8).cast("int"))), spoken)
    woman = F.concat(F.regexp_replace(name, r".\z", ""), F.when(canon.rlike("[а-яё]"), "а").when(canon.rlike("[α-ω]"), "α").otherwise("a"))
    man = F.concat(F.regexp_replace(name, r".\z", ""), F.when(canon.rlike("[а-яё]"), "н").when(canon.rlike("[α-ω]"), "ς").otherwise("n"))
    head = F.regexp_extract(canon, r"\A(.*?)[^.@]+\.\p{L}+\z", 1)
    email = F.concat(shape(head), F.lit("example"), F.regexp_extract(canon, r"\.\p{L}+\z", 0))
    ip = F.concat_ws(".", (1 + _draw(salt, F.lit(0), 223)).cast("string"), *[_draw(salt, F.lit(k), 256).cast("string") for k in (1, 2, 3)])
    digits = shape(canon)
    body = F.regexp_replace(digits, r".\z", "")
    checked = F.concat(body, F.element_at(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _luhn(F.concat(body, d))), 1))
    hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, k: _pick("0123456789abcdef", _draw(salt, k, 16))), "")
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", hexed)
            .when((kind == "card") & _luhn(canon), checked).when(kind == "given_f", woman).when(kind == "given_m", man)
            .when(kind.isin("given", "surname"), name).otherwise(digits))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canon, surrogate)`` for distinct ``(kind, canon)``, no two surrogates of a kind alike and none an original.

    Every round draws for the entities that are still without; of those that drew the
    same, the one whose canonical form comes first keeps it.  Runs jobs, one or two rounds
    in practice.
    """
    originals = written(entities.select("kind", "canon").distinct(), "entities")
    pending, done = originals, None
    for attempt in range(_MAX_DRAWS):
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key))
        taken = originals.select("kind", F.col("canon").alias("surrogate"))
        taken = taken if done is None else taken.unionAll(done.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).join(taken, ["kind", "surrogate"], "left_anti")
        won = written(first.select("kind", "canon", "surrogate"), "surrogates")
        done = won if done is None else done.unionAll(won)
        pending = written(pending.join(won, ["kind", "canon"], "left_anti"), "pending")
        if pending.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates after {_MAX_DRAWS} draws")


def _formatted(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate parts in the writing of the entity."""
    chars = F.split(entity, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
    digits = F.aggregate(chars, start, lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(c.rlike("[0-9]"), F.substring(made[0], acc["used"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        (acc["used"] + c.rlike("[0-9]").cast("int")).alias("used")))["out"]
    title = F.regexp_extract(entity, r"\A\p{L}+\.? ", 0)
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.regexp_replace(entity, r"\A\p{L}+\.? ", ""), F.lit("[ -]"), F.lit(0)))
    name = F.concat(title, F.array_join(F.zip_with(gaps, made, lambda g, w: F.concat(g, F.initcap(w))), ""))
    # a secret without lower-case letters stays so; in a mixed one every letter follows the character it stands for
    mixed = F.array_join(F.zip_with(chars, F.split(made[0], ""), lambda c, m: F.when(c.rlike("[A-F]"), F.upper(m)).otherwise(m)), "")
    secret = F.when(entity.rlike(r"\A[0-9A-F]*[A-F][0-9A-F]*\z"), F.upper(made[0])).otherwise(mixed)
    return F.when(kind == "name", name).when(kind.isin("card", "phone", "ssn"), digits).when(kind == "secret", secret).otherwise(made[0])


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """``(entity, kind, replacement)`` for distinct writings ``entity``."""
    typed = entities.withColumn("kind", type_of(F.col("entity")))
    split = written(typed.select("entity", "kind", F.posexplode(parts(F.col("kind"), F.col("entity"))).alias("at", "part")), "parts")
    split = split.select("entity", F.col("kind").alias("type"), "at", "part.kind", "part.canon")
    made = (split.join(assign(split, key), ["kind", "canon"]).groupBy("entity", "type")
            .agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("made")))
    made = made.withColumn("made", F.transform("made", lambda m: m["surrogate"]))
    return made.select("entity", F.col("type").alias("kind"), _formatted(F.col("type"), F.col("entity"), F.col("made")).alias("replacement"))


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace every entity in ``text`` and add ``n_replaced`` and ``pii_types`` (sorted); columns of these names are replaced.

    A null or empty text, or one without an entity, stays as it is with 0 and an empty
    list.  Repeated rows stay repeated; other columns pass through.  Runs jobs before it
    returns.  The key must be kept secret; the same key gives the same surrogates for the
    same set of entities.
    """
    spark = df.sparkSession
    rows = without(df, *[c for c in ("n_replaced", "pii_types") if c != text])
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    path = shared_path(spark, "pii-texts")
    rows.withColumn("__found", found).filter(F.size("__found") > 0).withColumn("__digest", F.sha2(text, 256)).write.parquet(path)
    held = spark.read.parquet(path)
    pairs = held.select("__digest", F.explode(F.array_distinct("__found")).alias("entity")).distinct()
    table = written(replacements(pairs.select("entity").distinct(), key), "replacements")
    # the pairs of a text are as many as its entities; texts are told apart by digest, so copies count once
    maps = written(pairs.join(table, "entity").groupBy("__digest").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("__map"), F.sort_array(F.collect_set("kind")).alias("pii_types")), "maps")
    pieces = F.split(F.col(text), ANY, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.col("__found"), lambda p, e: F.concat(p, F.coalesce(F.element_at(F.col("__map"), e), F.lit("")))), "")
    changed = (held.join(maps, "__digest").withColumn(text, rebuilt).withColumn("n_replaced", F.size("__found").cast("long"))
               .select(*rows.columns, "n_replaced", "pii_types"))
    plain = (rows.filter(~F.coalesce(F.col(text).rlike(ANY), F.lit(False)))
             .withColumns({"n_replaced": F.lit(0).cast("long"), "pii_types": F.array().cast("array<string>")}))
    return plain.unionByName(changed)
