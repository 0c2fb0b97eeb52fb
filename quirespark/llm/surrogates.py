"""PII surrogates, in DataFrame operations only.

Detected entities are replaced by keyed values of the same type and layout. An
entity's canonical form (the national digits of a phone, lower case of an address)
gives its surrogate, so that mentions in different layouts stay one entity. A name
is its words: each has a surrogate of its own kind (given name of a gender, family
name) and script, and once a title has shown a document's names, all further
mentions of their words in it are replaced too. Collisions among surrogates, or
with entities of the corpus, are found by grouping and keyed anew until all are
distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.llm.common import written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GAP = r"[^\p{L}\p{N}\n]"
#: Title words of each gender and of neither; the name that follows is the entity.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Señora", "Sra", "Dra", "Frau", "Madame", "Mme", "Госпожа"],
    "m": ["Mr", "Señor", "Sr", "Herr", "Monsieur", "Господин"],
    "n": ["Dr", "Prof", "Rev", "Доктор", "Δρ"],
}
#: Given names and name syllables by gender and script.
GIVEN = {
    ("f", "latin"): "Alma Berta Clara Dora Elsa Flora Greta Hanna Irma Julia Karla Lena Maria Nora Olga Petra".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Karl Leo Max Noel Otto Paul".split(),
    ("f", "cyrillic"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Ирина Карина Лидия Мария Нина Ольга Раиса Софья".split(),
    ("f", "greek"): "Άννα Βάσω Γιάννα Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λένα Μαρία Νίκη Ξένια Όλγα Ρένα".split(),
    ("m", "greek"): "Άρης Βασίλης Γιάννης Δήμος Ερμής Ζήσης Ηλίας Θάνος Ίων Κώστας Λέων Μάρκος Νίκος Ορέστης Πέτρος Σπύρος".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Семён".split(),
}
#: Where a title leaves the gender open, names of both.
GIVEN |= {("n", script): GIVEN["f", script] + GIVEN["m", script] for script in ("latin", "cyrillic", "greek")}
SYLLABLES = {
    "latin": "ba de fi go hu ka le mi no pu ra se ti vo wu za".split(),
    "cyrillic": "ба де фи го ху ка ле ми но пу ра се ти во ду за".split(),
    "greek": "βα δε φι γο χυ κα λε μι νο πυ ρα σε τι βο ζω θα".split(),
}
#: Each script's letters; names in other scripts get Latin surrogates.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
#: Particles between a title and a family name, which stay.
PARTICLES = "van von de der den del della di da du la le ten ter zu bin al el".split()
_WORD = r"\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+)*+"
_LEAD = rf"(?:(?:\p{{Lu}}\.|(?:{'|'.join(PARTICLES)})(?!\p{{L}})) ?)*"
_BEGIN = rf"(?=\p{{Lu}}|(?:{'|'.join(PARTICLES)})(?!\p{{L}}))"
#: Initials and particles, then one name or two.
_NAME = rf"{_LEAD}{_WORD}(?: {_LEAD}{_WORD})?"
#: Country codes of ITU-T E.164, fixed values.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _title(gender: str) -> str:
    return rf"(?i:{'|'.join(TITLES[gender])})"


#: Patterns in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "token": r"(?<![\p{L}\p{N}_-])(?:A(?:KI|SI)A[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[a-z]_[A-Za-z0-9]{20,}+|xox[a-z]-[A-Za-z0-9-]{10,}+"
    r"|[sp]k[-_](?:[a-z]+[-_])?[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*+)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": rf"\+\d{{1,3}}{_GAP}{{0,6}}\d{{2,4}}{_GAP}{{1,6}}\d{{3,4}}{_GAP}{{0,6}}\d{{4}}(?!\d)"
    # any other international number of 8 to 15 digits, with single separators and brackets
    r"|\+\d(?:[ .\-/  ‐-―]?\(?\d\)?){7,14}(?!\d)"
    r"|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)"
    r"|(?<![\p{L}\p{N}])(?:0[1-9](?:[ .-]\d{2}){4}|0\d{2,4} \d{3,4} \d{3,4})(?!\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?!\d)",
    # cheap looks first, as the look at the title is tried at every position that they pass
    "name_f": rf"(?<= ){_BEGIN}(?<=\b{_title('f')}\.? ){_NAME}",
    "name_m": rf"(?<= ){_BEGIN}(?<=\b{_title('m')}\.? ){_NAME}",
    "name_n": rf"(?<= ){_BEGIN}(?<=\b{_title('n')}\.? ){_NAME}",
}
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any match of the patterns holds: two digits with at most three other characters between them, an @, hex digits, a token's beginning or a title.
_MAY = rf"[0-9][^0-9\n]{{0,3}}[0-9]|@|::|[0-9A-Fa-f]{{32}}|A(?:KI|SI)A|AIza|gh[a-z]_|xox|[sp]k[-_]|eyJ|\b(?:{'|'.join(map(_title, TITLES))})\b"


def _escaped(text: Column) -> Column:
    """Frees U+0001 to mark entities; only control characters are put in, so no entity changes."""
    return F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02\x04")), F.lit("\x01"), F.lit("\x02\x03"))


def _restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\x02\x03"), F.lit("\x01")), F.lit("\x02\x04"), F.lit("\x02"))


def _pieces(text: Column) -> Column:
    """Plain text and entities in turn, beginning and ending with plain text."""
    return F.split(F.regexp_replace(_escaped(text), _ALL, "\x01$0\x01"), "\x01", -1)


def kind_of(value: Column) -> Column:
    """The first pattern that the whole value fits; a name's gender stands in its title, so it is asked for first."""
    found = None
    for kind in ("email", "secret", "token", "iban", "ip", "ipv6", "phone", "ssn", "card"):
        test = F.regexp_like(value, F.lit(rf"^(?:{PATTERNS[kind]})$"))
        found = F.when(test, kind) if found is None else found.when(test, kind)
    return found


def canonical(kind: Column, value: Column) -> Column:
    """One form for all layouts of an entity; of a phone the digits behind the country code or the leading 0."""
    digits = F.regexp_replace(value, r"\D", "")
    national = F.when(value.startswith("+"), F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("(0)"), F.lit("")), r"\D", ""), _COUNTRY, "")).otherwise(
        F.regexp_replace(digits, "^0", "")
    )
    return (
        F.when(kind == "phone", national)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind.isin("email", "secret", "ipv6"), F.lower(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(value)
    )


def name_words(name: Column) -> Column:
    """Array of (word, kind) of a name's words in lower case: all but the last are given names if there are several."""
    plain = F.regexp_replace(name, rf"\p{{Lu}}\.|(?<!\p{{L}})(?:{'|'.join(PARTICLES)})(?!\p{{L}})", " ")
    parts = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: w != "")
    last = F.element_at(parts, -1)
    letters = lambda w: F.regexp_extract_all(F.lower(w), F.lit(r"\p{L}{2,}"), F.lit(0))
    given = F.flatten(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), letters))
    of = lambda ws, kind: F.transform(ws, lambda w: F.struct(w.alias("word"), F.lit(kind).alias("part")))
    return F.when(F.size(parts) > 0, F.concat(of(given, "given"), of(letters(last), "family")))


def _sounds(script: str, parts: Column, byte) -> Column:
    known = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(parts, lambda i: F.element_at(known, byte(i) % 16 + 1)), "")


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, attempt) with the canonical form's keyed replacement."""
    seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    blocks = F.sequence(F.lit(0), F.floor(F.length("canon") / 64).cast("int"))
    stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 512)), "")
    keyed = entities.withColumn("_stream", stream)
    return keyed.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("_stream"))).drop("_stream")


def _surrogate(kind: Column, canon: Column, attempt: Column, stream: Column) -> Column:
    """Digits, letters and hex digits each by their own kind, from the bytes of a keyed hash."""

    def byte(i: Column) -> Column:
        return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def letter(i: Column) -> Column:
        return F.char(byte(i) % 26 + 97)

    def keyed(hexed: bool, frm: int = 0) -> Column:
        def one(c: Column, i: Column) -> Column:
            if hexed:
                return F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(byte(i) % 16))).otherwise(c)
            new = F.when(c.between("0", "9"), (byte(i) % 10).cast("string")).when(c.between("A", "Z"), F.upper(letter(i)))
            new = new.when(c.rlike(r"\p{L}"), letter(i)).otherwise(c)
            return F.when(i < frm, c).otherwise(new) if frm else new

        return F.array_join(F.transform(F.split(canon, ""), one), "")

    # where a type's values run out, later attempts have more digits, an address becomes one of the longer kind
    late = F.greatest(attempt - 3, F.lit(0))
    more = F.array_join(F.transform(F.sequence(F.lit(0), late), lambda i: F.when(i > 0, (byte(i + 20) % 10).cast("string")).otherwise("")), "")
    wide = F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.lower(F.substring(stream, 4 * i + 1, 4))) for i in range(6)))
    ip = F.when(late > 0, wide).otherwise(F.concat_ws(".", *((byte(F.lit(i)) % 254 + 1).cast("string") for i in range(4))))
    # the top-level domain stays; a long series of attempts makes the local part longer
    top = F.concat(F.lit("."), F.substring_index(canon, ".", -1))
    email = F.concat(F.repeat(letter(F.lit(0)), F.greatest(attempt - 3, F.lit(0))), F.substring(keyed(False), F.lit(1), F.length(canon) - F.length(top)), top)
    # a card number that passes the check digit test still does, another still doesn't
    body = F.substring(keyed(False), F.lit(1), F.length(canon) - 1)
    fit = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))[0]
    card = F.concat(body, F.when(F.call_function("luhn_check", canon), fit).otherwise((fit + 1) % 10).cast("string"))
    found = F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "card", F.concat(card, more))
    found = found.when(kind == "secret", F.concat(keyed(True), more)).when(kind == "ipv6", F.when(late > 0, wide).otherwise(keyed(True)))
    # an account keeps its country, a token the beginning that says what it is
    found = found.when(kind == "iban", F.concat(keyed(False, 2), more)).when(kind == "token", F.concat(keyed(False, 4), more))
    script = F.lit("latin")
    for other, letters in SCRIPTS.items():
        script = F.when(canon.rlike(letters), other).otherwise(script)
    for name in SYLLABLES:
        ending = lambda least: _sounds(name, F.sequence(F.lit(1), F.least(attempt + least, F.lit(30))), byte)  # noqa: E731, B023
        for gender in TITLES:
            known = GIVEN[gender, name]
            given = F.element_at(F.array(*map(F.lit, known)), byte(F.lit(0)) % len(known) + 1)
            given = F.lower(F.when(attempt > 0, F.concat(given, ending(0))).otherwise(given))
            found = found.when((kind == f"given_{gender}") & (script == name), given)
        found = found.when((kind == "family") & (script == name), ending(4))
    return found.otherwise(F.concat(keyed(False), more))


def laid_out(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the mention's layout: separators, country code and upper case where the mention has them."""
    signs = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    start = F.when(kind == "phone", F.least(F.lit(1), F.length(new) - signs + 1)).otherwise(F.lit(1))
    walked = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit("").alias("s"), start.alias("k")),
        lambda acc, c: F.when(
            c.rlike("[0-9A-Za-z]"),
            F.struct(F.concat(acc["s"], F.when(acc["k"] < 1, c).otherwise(F.substring(new, acc["k"], F.lit(1)))).alias("s"), (acc["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k"))),
        lambda acc: F.concat(acc["s"], F.substring(new, acc["k"], F.length(new))),
    )
    shouted = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(new)).otherwise(new)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), walked).when(kind.isin("email", "secret", "ipv6"), shouted).otherwise(new)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, kind, value, n) for each distinct entity of each document."""
    titled = lambda g: F.col("before").rlike(rf"\b{_title(g)}\.? $")
    kind = F.coalesce(kind_of(F.col("value")), *(F.when(titled(g), f"name_{g}") for g in TITLES))
    return (
        docs.where(F.col(text_col).rlike(_MAY))
        .select(F.col(id_col).alias("doc"), _pieces(F.col(text_col)).alias("p"))
        .where("size(p) > 1")
        .select("doc", F.explode(F.expr("filter(transform(p, (x, i) -> struct(x AS value, if(i > 0, p[i - 1], '') AS before, i AS i)), s -> s.i % 2 = 1)")).alias("s"))
        .select("doc", "s.value", "s.before")
        .select("doc", kind.alias("kind"), "value")
        .groupBy("doc", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate), all surrogates of a kind distinct and none an entity of the corpus.

    Of entities that meet in one surrogate the first in order keeps it and the
    others are keyed anew, as is one whose surrogate is itself an entity. Later
    attempts have longer values, so there is always one that is free.
    """
    now = written(with_surrogate(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        least = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("least"), F.count(F.lit(1)).alias("n"))
        clash = least.join(real, ["kind", "surrogate"], "left").where("n > 1 or real")
        if clash.isEmpty():
            return now.drop("attempt")
        again = now.join(clash, ["kind", "surrogate"], "left").withColumn("anew", F.coalesce(F.col("real") | (F.col("least") < F.col("canon")), F.lit(False)))
        now = written(with_surrogate(again.select("kind", "canon", (F.col("attempt") + F.col("anew").cast("int")).alias("attempt")), key), "surrogates")


#: Where a run of letters begins or ends.
_EDGES = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity replaced, plus n_entities (mentions) and n_distinct.

    The same key gives the same surrogates, but where a collision is resolved,
    which depends on the corpus. A name counts as a mention where a title precedes
    it; in its document its words are also replaced wherever else they stand with an
    upper-case letter. Texts without entities, null and empty ones stay as they are
    and are not shuffled. Rows that repeat an id get the same surrogates. All columns
    are kept, but columns of the added names are replaced; a null id is an id like
    any other.
    """
    docs = docs.drop("n_entities", "n_distinct")
    found = written(mentions(docs, id_col, text_col).withColumn("canon", canonical(F.col("kind"), F.col("value"))), "mentions")
    named = F.col("kind").startswith("name_")
    gender = F.substring("kind", 6, 1)
    parts = found.where(named).select("doc", gender.alias("gender"), F.explode(name_words(F.col("value"))).alias("w"))
    parts = parts.select("doc", F.col("w.word").alias("canon"), F.when(F.col("w.part") == "family", "family").otherwise(F.concat(F.lit("given_"), "gender")).alias("kind"))
    table = distinct_surrogates(found.where(~named).select("kind", "canon").unionAll(parts.select("kind", "canon")).distinct(), key)
    entries = (
        found.where(~named)
        .join(table, ["kind", "canon"])
        .select("doc", "value", laid_out(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new"))
        .unionAll(parts.distinct().join(table, ["kind", "canon"]).select("doc", F.concat(F.lit("\x01"), "canon").alias("value"), F.col("surrogate").alias("new")))
        # of a word that is a given and a family name one surrogate counts
        .groupBy("doc", "value")
        .agg(F.min("new").alias("new"))
        .groupBy("doc")
        .agg(F.collect_list(F.struct("value", "new")).alias("_es"))
    )
    counts = found.groupBy(F.col("doc").alias("_of")).agg(F.count_distinct("kind", "canon").alias("_distinct"))
    by_doc = entries.join(counts, F.col("doc").eqNullSafe(F.col("_of"))).select("doc", "_es", "_distinct")
    # an input row is one struct beside the helpers, so that none of its columns can clash with them
    held = docs.select(F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"))
    body = F.col("row").getField(text_col)
    marked = held.withColumn("_p", F.when(body.rlike(_MAY), _pieces(body)))
    has = F.coalesce(F.size("_p") > 1, F.lit(False)) & F.col("_p").isNotNull()
    fields = [F.col("row").getField(c).alias(c) for c in docs.columns]
    plain = marked.where(~has).select(*fields, F.lit(0).cast("long").alias("n_entities"), F.lit(0).cast("long").alias("n_distinct"))
    rest = marked.where(has)
    joined = rest.join(by_doc, F.col("row").getField(id_col).eqNullSafe(F.col("doc"))).withColumn("_m", F.map_from_entries("_es"))
    joined = joined.withColumn("_names", F.exists("_es", lambda e: e["value"].startswith("\x01"))).withColumn("_edges", F.lit(_EDGES))
    # capitals as the mention has them
    word = "if(x rlike '^\\\\p{Lu}', coalesce(if(length(x) > 1 and upper(x) = x, upper(_m['\x01' || lower(x)]), initcap(_m['\x01' || lower(x)])), x), x)"
    spoken = f"if(_names, array_join(transform(split(y, _edges), x -> {word}), ''), y)"
    text = _restored(F.array_join(F.expr(f"transform(_p, (y, i) -> coalesce(if(i % 2 = 1, _m[y], null), {spoken}))"), ""))
    return plain.unionAll(
        joined.select(
            *(text.alias(c) if c == text_col else field for c, field in zip(docs.columns, fields, strict=True)),
            F.floor(F.size("_p") / 2).cast("long").alias("n_entities"),
            F.col("_distinct").cast("long").alias("n_distinct"),
        )
    )
