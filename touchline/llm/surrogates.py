"""Surrogates for personal data, in DataFrame functions only.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (Luhn-valid), US social security numbers,
names after honorifics (all words of the name), and credentials (access key ids, values after ``password=``, ``token = "..."`` and the like).

Each entity is reduced to its type and canonical form (letters and digits in lower case), and gets a replacement drawn
from a keyed hash: digits for digits, letters for letters, upper case where the original has it, punctuation as it
stands, the country code of a telephone number and the first digit of a card kept, cards Luhn-valid again, e-mail domains
below the reserved ``.example``, given names of the honorific's gender in the script of the name. The same entity is
replaced alike everywhere (coreference). A surname, the last word of a name with the particles before it, is an entity of its own, so that
"Mr John Smith", "Mr Smith" and "Dr Smith" share one; given names are drawn for the whole name, with initials where a
surname has more bearers than there are given names. All distinct entities are then checked together: where two would get
the same replacement, or one gets the text of a real entity, all but one draw again, until none is left
(distinctness). Later draws of names, e-mail addresses and secrets are longer, so their space does not fill up. Where the
values of a fixed form (digits, addresses, key ids) are nearly all in use, that form's entities are dealt each other's
values in a keyed order: still distinct, and none keeps its own, but real values of others. Nothing is collected: entities, checks and replacements are tables.

Defined cases: a null text stays null, an empty one empty, both with 0 entities. Equal texts get equal results; repeated
rows stay. Texts without an entity are returned as they are. An empty table gives an empty result. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import free_name, stored

KEY = "surrogates-1"
#: Draws after which a fixed form's space counts as full, and its entities exchange their own values.
MAX_DRAWS = 50
#: Tasks that the names of one surname are dealt to.
SALTS = 16

# -- detection. Every alternative starts at a place where no entity can have begun before, and runs are possessive.

HONORIFICS = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа", "Κυρία"),
    "m": ("Mr", "Herr", "Señor", "Monsieur", "г-н", "Κύριος"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Mx"),
}
_TITLE = "|".join(sorted((t for ts in HONORIFICS.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PARTICLE = "van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|zu|zum|zur|bin|al|el"
#: A word of a name: inner and all capitals, O'Brien, Meyer-Landrut; or an initial before another word.
_NAME = (
    rf"(?:(?:{_PARTICLE}) )*+(?!(?:{_TITLE})\.? )"
    r"(?:\p{Lu}\.(?= \p{Lu})|\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+|-[\p{L}\p{M}]++)*+)"
)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+"
PHONE = (
    r"(?<![\w+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"
    r"|(?<![\w+.])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\w-])"
    r"|(?<![\w+.])\+\d{8,15}(?![\w-])"
    r"|(?<![\w+.])(?=\+(?:[ .()-]{0,2}\d){8})\+\d{1,3}(?:[ .-]?\(\d{1,4}\)[ .-]?\d{1,4}|[ .-]\d{1,4})(?:[ .-]\d{2,8}){1,5}(?![\w-])"
    r"|(?<![\w+.-])\(\d{2,5}\)[ .-]?\d{5,8}(?![\w-])"
    r"|(?<![\w+.-])(?<!\d )\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])(?! \d)"
    r"|(?<![\w+.-])(?<!\d )0(?:\d(?:[ .-]\d{2}){4}|\d{1,4}[ /-]\d{5,8}|\d{1,4} \d{3,4} \d{3,4})(?![\w-])(?! \d)"
)
IP = rf"(?<![\w.-])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w-]|\.\d)"
CARD = r"(?<![\w+.-])[2-6]\d{3}(?:([ -]?)\d{4}\1\d{4}\1\d{1,7}|[ -]\d{6}[ -]\d{5}|\d{9,11})(?![\w-])"
SSN = r"(?<![\w+.-])\d{3}-\d{2}-\d{4}(?![\w-])"
KEY_ID = r"(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w)"
SECRET = r"(?<!\w)(?i:password|passwd|pwd|secret|token|api[_-]?key)(?: ?[=:] ?\"[^\"\s]{6,}+\"|[=:][^\s\"',;]{6,}+)"
_HEAD = rf"(?:(?:{_TITLE})\.? )+"
NAME = rf"(?<!\w){_HEAD}{_NAME}(?: {_NAME})*+"

CARD_FREE = CARD.replace("([ -]?)", "(?:[ -]?)").replace(r"\1", "[ -]?")
ENTITY = "|".join((EMAIL, SECRET, KEY_ID, IP, SSN, PHONE, CARD_FREE, NAME))
#: Texts without any of these hold no entity; the search costs far less than the full expression.
HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:]|A[KS]IA[A-Z0-9]{{16}}|(?:{_TITLE})\.? (?:(?:{_PARTICLE}) )*\p{{Lu}}"

# -- fixed values: given names by script and gender
GIVEN = {
    "latin_f": "Anna Clara Emma Helen Julia Laura Maria Nina Olga Paula Rosa Sara Tina Vera Wanda Zoe",
    "latin_m": "Adam Boris Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Martin Oscar Paul Victor",
    "cyrillic_f": "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья Тамара Юлия",
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Иван Кирилл Леонид Максим Олег Павел Роман",
    "greek_f": "Άννα Δήμητρα Ειρήνη Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
    "greek_m": "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σταύρος",
}
SYLLABLES = {
    "latin": "ba den fi gor hal kin lo mar nel or pes ran sol tur vic wen",
    "cyrillic": "ба вин го дар за кин лов мар нев ор пет ран сол тур фед ши",
    "greek": "βα γιο δα ζη θε κο λα μι νο πα ρα σα τη φο χα ψη",
}


def _hex(seed: Column, start: int, length: int) -> Column:
    """A number drawn from a hexadecimal digest."""
    return F.conv(F.substr(seed, F.lit(start), F.lit(length)), 16, 10).cast("long")


def entity_type(value: Column) -> Column:
    return (
        F.when(value.rlike(rf"^(?:{SECRET})$"), "secret")
        .when(value.rlike(rf"^(?:{EMAIL})$"), "email")
        .when(value.rlike(rf"^(?:{KEY_ID})$"), "key_id")
        .when(value.rlike(rf"^(?:{IP})$"), "ip")
        .when(value.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(value.rlike(rf"^(?:{NAME})$"), "name")
        .when(value.rlike(rf"^(?:{PHONE})$"), "phone")
        .otherwise("card")
    )


def luhn_sum(digits: Column) -> Column:
    """Sum by Luhn of a text of digits, its last digit being the check digit."""
    at = F.split(F.reverse(digits), "")
    doubled = F.transform(at, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def is_entity(kind: Column, value: Column) -> Column:
    """Cards need a valid check digit; everything else is an entity by its shape."""
    return (kind != "card") | (luhn_sum(F.regexp_replace(value, r"\D", "")) % 10 == 0)


def split_value(kind: Column, value: Column) -> tuple[Column, Column]:
    """A fixed head of the entity's text, and the rest that is to be replaced."""
    secret = F.regexp_extract(value, r"^(\w+(?:-\w+)? ?[=:] ?\"?)", 1)
    name = F.regexp_extract(value, rf"^({_HEAD})", 1)
    phone = F.regexp_extract(value, r"^(\+\d{1,3}(?=[ (.-])|\+\d{2})", 1)
    head = (
        F.when(kind == "secret", secret)
        .when(kind == "name", name)
        .when(kind == "phone", phone)
        .when(kind == "key_id", F.substring(value, 1, 4))
        .when(kind == "card", F.substring(value, 1, 1))
        .otherwise("")
    )
    return head, F.substr(value, F.length(head) + 1, F.length(value))


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: letters and digits, lower case; gender and words for names.

    Kept heads belong to it, so that no two entities differ in nothing but their head.
    """
    head, rest = split_value(kind, value)
    says = lambda g: head.rlike(rf"(?:^| )(?:{'|'.join(HONORIFICS[g])})\.? ")
    gender = F.when(says("f"), "f").when(says("m"), "m").otherwise("n")
    return (
        F.when(kind == "name", F.concat_ws(" ", gender, F.lower(rest)))
        .when(kind == "secret", F.regexp_replace(rest, "\"$", ""))
        .when(kind == "phone", F.concat_ws("-", F.regexp_replace(head, r"\D", ""), F.regexp_replace(rest, r"\D", "")))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "ip", value)
        .otherwise(F.lower(value))
    )


def _shifted(text: Column, seed: Column) -> Column:
    """Each digit replaced by a digit and each lower-case letter by a letter (a-f where all are hexadecimal)."""
    hexadecimal = text.rlike("^[0-9a-f]+$")
    pool = F.concat(*[F.sha2(F.concat_ws("|", seed, F.lit(str(i))), 256) for i in range(2)])

    def one(c: Column, i: Column) -> Column:
        drawn = F.conv(F.substr(pool, i * 2 % 126 + 1, F.lit(2)), 16, 10).cast("int")
        letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), drawn % F.when(hexadecimal, 6).otherwise(26) + 1, F.lit(1))
        upper = F.upper(letter)
        return (
            F.when(c.rlike("[0-9]"), (drawn % 10).cast("string"))
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[A-Z]"), upper)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _pick(words: str, number: Column) -> Column:
    options = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in options]), (number % len(options) + 1).cast("int"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def drawn(kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of a canonical form, at a draw."""
    seed = F.sha2(F.concat_ws("|", F.lit(KEY), kind, canon, attempt.cast("string")), 256)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    # A domain is replaced alike for all its addresses, whatever the draw.
    of_domain = F.sha2(F.concat_ws("|", F.lit(KEY), F.lit("domain"), domain), 256)
    site = F.regexp_replace(domain, r"\.[^.]+$", "")
    # The second draw after the first collision begins to be longer, by one more letter each.
    letters = F.translate(F.substr(F.sha2(seed, 256), F.lit(1), F.greatest(F.least(attempt - 1, F.lit(16)), F.lit(0))), "0123456789", "ghijklmnop")
    email = F.concat(_shifted(local, seed), letters, F.lit("@"), _shifted(site, of_domain), F.lit(".example"))
    octets = F.array_join(F.array(*[(_hex(seed, 1 + 8 * i, 8) % 254 + 1).cast("string") for i in range(4)]), ".")
    # Cards: all digits but the first and the last are drawn, the last makes the sum right.
    body = F.concat(F.substring(canon, 1, 1), _shifted(F.substr(canon, F.lit(2), F.length(canon) - 2), seed))
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, check.cast("string"))
    script = _script(canon)
    gender = F.substring(canon, 1, 1)
    given, surname = None, None
    for s in SYLLABLES:
        # Each draw after the first has a syllable, or an initial, more.
        parts = [_pick(SYLLABLES[s], _hex(seed, 9 + 4 * i, 4)) for i in range(14)]
        initials = [F.when(attempt > i, F.concat(F.lit(" "), F.upper(F.substring(part, 1, 1)), F.lit("."))).otherwise("") for i, part in enumerate(parts)]
        parts = [part if i < 4 else F.when(attempt > i - 4, part).otherwise("") for i, part in enumerate(parts)]
        family = F.initcap(F.concat(*parts))
        surname = F.when(script == s, family) if surname is None else surname.when(script == s, family)
        for g in "fmn":
            first = F.concat(_pick(" ".join(GIVEN[f"{s}_{x}"] for x in ("fm" if g == "n" else g)), _hex(seed, 1, 8)), *initials)
            both = (script == s) & (gender == g)
            given = F.when(both, first) if given is None else given.when(both, first)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "name", given)
        .when(kind == "surname", surname)
        .when(kind == "key_id", F.concat(F.substring(canon, 1, 4), _shifted(F.substring(canon, 5, 16), seed)))
        .when(kind == "phone", F.concat(F.substring_index(canon, "-", 1), F.lit("-"), _shifted(F.substring_index(canon, "-", -1), seed)))
        .when(kind == "secret", F.concat(_shifted(canon, seed), letters))
        .otherwise(_shifted(canon, seed))
    )


def worn(kind: Column, value: Column, replacement: Column) -> Column:
    """The replacement in the dress of this mention: its punctuation, upper case and head."""
    head, rest = split_value(kind, value)
    # The digits behind the head's own are laid out over the rest of the mention.
    tail = (
        F.when(kind == "phone", F.substring_index(replacement, "-", -1))
        .when(kind == "card", F.substr(replacement, F.lit(2), F.length(replacement)))
        .otherwise(replacement)
    )
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def lay(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        put = F.when(digit, F.substr(tail, acc["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["s"], put).alias("s"), F.when(digit, acc["at"] + 1).otherwise(acc["at"]).alias("at"))

    laid = F.concat(head, F.aggregate(F.split(rest, ""), start, lay)["s"])
    upper_local = value.rlike("^[^a-z@]*[A-Z][^a-z@]*@")
    email = F.when(upper_local, F.concat(F.upper(F.substring_index(replacement, "@", 1)), F.lit("@"),
                                         F.substring_index(replacement, "@", -1))).otherwise(replacement)
    return (
        F.when(kind.isin("phone", "card", "ssn"), laid)
        .when(kind == "email", email)
        .when(kind == "key_id", F.upper(replacement))
        .when(kind == "secret", F.concat(head, replacement, F.when(value.endswith('"'), '"').otherwise("")))
        .when((kind == "name") & (F.length(rest) > 1) & (rest == F.upper(rest)), F.concat(head, F.upper(replacement)))
        .when(kind == "name", F.concat(head, replacement))
        .otherwise(replacement)
    )


# -- tables


def surname_of(canon: Column) -> Column:
    """The last word of a canonical name and the particles before it."""
    return F.regexp_extract(canon, rf"((?:(?<![^ ])(?:{_PARTICLE}) )*[^ ]+)$", 1)


def mentions(texts: DataFrame) -> DataFrame:
    """digest, pos, value, kind and canon of every match in the distinct texts of ``texts`` (digest, found); canon is null for what is no entity."""
    rows = texts.select("digest", F.posexplode("found").alias("pos", "value"))
    rows = rows.withColumn("kind", entity_type(F.col("value")))
    return rows.withColumn("canon", F.when(is_entity(F.col("kind"), F.col("value")), canonical(F.col("kind"), F.col("value"))))


def _exchanged(entities: DataFrame, open_: DataFrame) -> DataFrame:
    """``entities`` with each form of those still ``open_`` dealt its own values, one on in a keyed order."""
    # What worn() keeps of a mention, the head and the number of digits, is the form.
    kept = F.when(F.col("kind") == "phone", F.substring_index("canon", "-", 1)).when(F.col("kind") == "card", F.substring("canon", 1, 1))
    kept = kept.when(F.col("kind") == "key_id", F.substring("canon", 1, 4)).otherwise("")
    form = F.concat_ws("|", "kind", kept, F.when(F.col("kind") != "ip", F.length("canon")))
    full = open_.select(form.alias("form")).distinct().withColumn("full", F.lit(True))
    keyed = W.partitionBy("form").orderBy(F.sha2(F.concat_ws("|", F.lit(KEY), "canon"), 256), "canon")
    rows = entities.withColumn("form", form).join(full, "form", "left")
    dealt = rows.where("full").withColumn("replacement", F.coalesce(
        F.lead("canon").over(keyed), F.first("canon").over(keyed.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    columns = ["kind", "canon", "replacement"]
    return rows.where("full is null").select(*columns).unionByName(dealt.select(*columns))


def replacements(rows: DataFrame) -> DataFrame:
    """kind, canon and replacement of every distinct entity; no two of a kind share one, none is a real entity.

    Names without a given name are told by their surname alone, whatever the honorific.
    """
    entities = stored(rows.where("canon is not null").select("kind", "canon").distinct(), "distinct")
    names = entities.where("kind = 'name'").withColumn("surname", surname_of(F.col("canon")))
    families = names.select(F.lit("surname").alias("kind"), F.col("surname").alias("canon")).distinct()
    apart = _settled(entities.where("kind <> 'name'").unionByName(families).withColumn("tail", F.lit("")))
    family = apart.where("kind = 'surname'").select(F.col("canon").alias("surname"), F.col("replacement").alias("family"))
    # A surname may be borne by a large part of all names, so its names are dealt to several tasks.
    salted = family.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    names = names.withColumn("salt", F.pmod(F.xxhash64("canon"), F.lit(SALTS)).cast("int"))
    named = stored(names.join(salted, ["surname", "salt"]).drop("salt"), "names")
    alone = F.length("canon") == F.length("surname") + 2
    single = named.where(alone).select("kind", "canon", F.col("family").alias("replacement"))
    full = _settled(named.where(~alone).select("kind", "canon", F.concat(F.lit(" "), "family").alias("tail")))
    return apart.where("kind <> 'surname'").unionByName(single).unionByName(full)


def _settled(entities: DataFrame) -> DataFrame:
    """kind, canon and replacement of distinct entities (kind, canon, tail); the tail is what each draw ends with."""
    made = F.concat(drawn(F.col("kind"), F.col("canon"), F.col("attempt")), "tail")
    entities = entities.withColumn("attempt", F.lit(0)).withColumn("replacement", made)
    entities = stored(entities, "entities")
    # Names are compared without their gender and in lower case.
    name = F.col("kind").isin("name", "surname")
    real_text = F.when(F.col("kind") == "name", F.substr("canon", F.lit(3))).otherwise(F.col("canon"))
    text = F.when(name, F.lower("replacement")).otherwise(F.col("replacement"))
    for draw in range(MAX_DRAWS):
        real = entities.select("kind", real_text.alias("as_text"), F.lit(None).cast("string").alias("canon"))
        every = real.unionByName(entities.withColumn("as_text", text), allowMissingColumns=True)
        turn = F.row_number().over(W.partitionBy("kind", "as_text").orderBy(F.col("canon").asc_nulls_first()))
        checked = every.withColumn("turn", turn).where("canon is not null").drop("as_text")
        again = F.col("turn") > 1
        left = checked.where(again)
        if left.isEmpty():
            return entities.select("kind", "canon", "replacement")
        if draw == MAX_DRAWS - 1:
            return stored(_exchanged(entities, stored(left.select("kind", "canon"), "full")), "entities")
        # The draw goes up by the place among those that collide, so a large group does not collide once more as a whole.
        checked = checked.withColumn("attempt", F.when(again, F.col("attempt") + F.col("turn") - 1).otherwise(F.col("attempt")))
        fresh = checked.withColumn("replacement", F.when(again, made).otherwise(F.col("replacement")))
        entities = stored(fresh.select("kind", "canon", "tail", "attempt", "replacement"), "entities")


def pseudonymised(documents: DataFrame) -> DataFrame:
    """The documents, all their columns, with surrogates in ``text``, and last ``n_entities``.

    If the documents have a column of that name, the added one has underscores behind it.
    """
    names = documents.columns
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    digest = F.md5(F.col("text").cast("binary"))
    # A documents column could have any name; they travel by position.
    rows = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col("text"))
    at_text = names.index("text")
    texts = documents.select("text").where(F.col("text").rlike(HINT)).select(digest.alias("digest"), found.alias("found"))
    texts = texts.where(F.size("found") > 0)
    # One row for each distinct text, however often it occurs.
    rows_of = stored(mentions(texts).distinct(), "mentions")
    known = replacements(rows_of)
    worn_as = worn(F.col("kind"), F.col("value"), F.col("replacement"))
    by_text = (
        rows_of.join(known, ["kind", "canon"], "left")
        .withColumn("worn", F.coalesce(worn_as, "value"))
        .groupBy("digest")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "worn"))).alias("worn"), F.count("canon").alias("n_entities"))
    )
    holds = F.col("text").rlike(HINT) & F.coalesce(F.col("text").rlike(ENTITY), F.lit(False))
    with_some = rows.where(holds).withColumn("digest", digest).join(by_text, "digest", "left")
    # The pieces between matches and what takes their place alternate; the text is matched once for both.
    put = F.transform(F.split("text", ENTITY, -1), lambda piece, i: F.concat(piece, F.coalesce(F.try_element_at(F.col("worn"), i), F.lit(""))))
    done = with_some.withColumn("text", F.array_join(put, "")).withColumn("n_entities", F.coalesce("n_entities", F.lit(0)).cast("long"))
    rest = rows.where(~F.coalesce(holds, F.lit(False))).withColumn("n_entities", F.lit(0).cast("long"))
    both = done.drop("digest", "worn").unionByName(rest)
    columns = [F.col("text" if i == at_text else f"k{i}").alias(c) for i, c in enumerate(names)]
    return both.select(*columns, F.col("n_entities").alias(free_name(names, "n_entities")))


def surrogate_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_entities and the text with surrogates of every document."""
    return pseudonymised(documents.select("doc_id", "text")).select("doc_id", "n_entities", "text")
