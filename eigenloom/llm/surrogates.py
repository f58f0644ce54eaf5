"""Personal data replaced by keyed surrogates, in DataFrame operations only (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import as_table, scratch_path
from .block_naming import columns_of, row_keys, whole_row

# Titles that give away a gender, titles that do not, words within names, made-up given names and
# syllables by script, alphabets.
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mme", "Mlle", "Госпожа", "Κυρία")
TITLES_M = ("Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος")
TITLES_N = ("Dr", "Prof", "Professor", "Rev")
TITLES_CAPITAL = ("MR", "MRS", "MISS", "FRAU", "HERR", "PROF", "PROFESSOR")
PARTICLES = ("de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "van", "von", "zu", "al", "bin", "ben", "ibn", "ter")
GIVEN = {
    ("f", "latin"): ("Ada", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna"),
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Олег", "Павел"),
    ("f", "greek"): ("Άννα", "Δάφνη", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία", "Χλόη"),
    ("m", "greek"): ("Άρης", "Δήμος", "Ηλίας", "Λουκάς", "Νίκος", "Πάνος", "Στέλιος", "Φώτης"),
}
SYLLABLES = {
    "latin": ("bar", "del", "fan", "gor", "hal", "kem", "lun", "mir", "nol", "per", "rin", "sol", "tav", "ver", "wen", "zel"),
    "cyrillic": ("бар", "вел", "гор", "дан", "зел", "кам", "лун", "мир", "нов", "пер", "рин", "сол", "тав", "фан", "хал", "чер"),
    "greek": ("βαρ", "γορ", "δελ", "ζελ", "θαν", "καμ", "λουν", "μιρ", "νολ", "περ", "ριν", "σολ", "ταβ", "φαν", "χαλ", "ψιλ"),
}
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя",
    "greek": "αβγδεζηθικλμνοπρστυφχψω",
}

# So many draws keep the make-up of a value. Later ones are longer, by one more character each time.
TRIES = 6

# Country codes of one and two digits; all others have three, and none begins another.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

LETTER = r"[\p{L}\p{N}]"
TITLE = (
    "(?:(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")(?![\p{L}\p{N}])\.?"
    r"|(?:(?:" + "|".join(TITLES_CAPITAL) + r")(?![\p{L}\p{N}])\.?|DR\.)(?= \p{Lu}{2}))"
)
# A word of a name, without an ending after an apostrophe; initials and particles that may stand before one.
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)*"
BEFORE_WORD = r"(?:\p{Lu}\. ?|(?:" + "|".join(PARTICLES) + ") )*"
TELLING = "token|secret|password|passwd|passphrase|pwd|api.?key"
BARE = r"[A-Za-z0-9_!@#$%^&*+/=~-]"
HEX4 = "[0-9A-Fa-f]{1,4}"
# First digits of card numbers with as many digits as they have.
ISSUERS = r"4(?:[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7]|35|6[05])[0-9]{14}|3[47][0-9]{13}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Kind of entity and its pattern, in order of precedence. None matches the empty string or captures a group.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": rf"(?<=[=:\"' ])(?<=(?i:{TELLING})[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)"
    r"(?:(?<=[\"'])(?=[^\"'\s]*[\p{L}\p{N}])[^\"'\s]{6,}(?=[\"'])"
    rf"|(?={BARE}*[0-9])(?={BARE}*[A-Za-z]){BARE}{{6,}}+(?=[\s,;\"'<]|\.(?:\s|$)|$))"
    r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})\b"
    r"|\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
    r"|(?<=KEY-----)(?<=-----BEGIN (?:[A-Z]{2,10} )?(?:[A-Z]{2,10} )?PRIVATE KEY-----)(?=\s*[A-Za-z0-9])[A-Za-z0-9+/=\s]++(?=-----END )"
    r"|(?<![\p{L}\p{N}])(?=[A-Fa-f]{0,63}[0-9])[0-9A-Fa-f]{32,64}(?![\p{L}\p{N}])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:[23][0-9A-Fa-f]{{3}}|(?i:fe[89ab][0-9a-f]|f[cd][0-9a-f]{{2}}))"
    rf"(?:(?::{HEX4}){{7}}|(?::{HEX4}){{0,6}}::{HEX4}(?::{HEX4}){{0,5}})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\p{L}\p{N}+.])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}-])"
    r"|(?<![\p{L}\p{N}.,+/-])(?=0(?:[ /-]?[0-9]){8,10}(?![ /-]?[0-9]|\p{L}))0[1-9][0-9]{0,3}(?:[ -]|(?<=[0-9]{3})/)[0-9]{2,8}(?:[ -][0-9]{2,8}){0,4}",
    "ip": r"(?<![\p{L}\p{N}.])(?<!\b(?i:v|ver|version|release|build|firmware)[.:]? ?)"
    rf"(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE} {BEFORE_WORD}{WORD}(?: {BEFORE_WORD}{WORD})?",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
# In texts that name someone after a title every word that may be part of a name is found as well, as group 1.
WIDE = rf"{ENTITY}|(?<![\p{{L}}\p{{N}}])({WORD})(?![\p{{L}}\p{{N}}])"
# Every entity holds one of these: texts without are left alone at the cost of one quick search.
HINT = rf"[0-9@]|(?i:token|secret|passw|passphrase|pwd|api.?key)|PRIVATE KEY|\b(?:AKIA|gh[pousr]_|sk-|eyJ)|(?<![\p{{L}}\p{{N}}]){TITLE} "
NAMES = ("given_f", "given_m", "given_n", "surname")


def byte_at(hexed: Column, at: Column) -> Column:
    """Byte ``at`` (from 0) of a hexadecimal string of 256 digits, over again after 128 bytes."""
    return F.conv(F.substring(hexed, F.pmod(at, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(choices, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), F.pmod(number, F.lit(len(choices))) + 1)


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def by_script(text: Column, make) -> Column:
    script = script_of(text)
    out = F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek"))
    return out.otherwise(make("latin"))


def capitals(form: Column) -> Column:
    return (F.upper(form) == form) & (F.lower(form) != form)


def kind_of(form: Column) -> Column:
    """The first kind whose pattern the whole form fits; contexts before and after count as met."""
    bare = {k: p for k, p in KINDS.items() if k != "secret"}
    out = None
    for kind in ("name", "email", "iban", "ip6", "phone", "ip", "ssn", "card"):
        test = form.rlike(f"^(?:{bare[kind]})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("secret")


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A value of the same kind and make-up, a function of key, kind, value and attempt alone.

    Made-up names have a syllable more with each attempt, so there are enough for any number of values.
    From attempt ``TRIES`` on, and from the first one on if nothing in the value can change, characters are
    added (before e-mail addresses, behind the others): however full a make-up is, there is a free surrogate.
    """
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    hexed = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{n}")), 256) for n in range(4)])
    keep = F.when(kind == "email", F.length(value) - F.instr(F.reverse(value), ".")).otherwise(F.length(value))
    skip = F.when(kind == "phone", F.instr(value, " ")).when(kind == "iban", F.lit(2)).when(kind == "ip6", F.lit(4)).otherwise(F.lit(0))
    hexadecimal = (kind == "ip6") | (kind == "secret") & value.rlike("^[0-9a-f]+$")

    fixed = ~F.substring(value, skip + 1, keep - skip).rlike(LETTER)
    added = F.when(fixed & ~kind.isin("ip", *NAMES), attempt + 1)
    added = added.otherwise(F.greatest(attempt + 1 - TRIES, F.lit(0)))

    def change(ch: Column, at: Column) -> Column:
        code = byte_at(hexed, at)
        letter = by_script(ch, lambda s: pick(tuple(ALPHABETS[s]), code))
        new = F.when(hexadecimal & ch.rlike("[0-9a-f]"), pick(tuple("0123456789abcdef"), code)).when(ch.rlike("[0-9]"), pick(tuple("0123456789"), code))
        new = new.when(ch.rlike(r"\p{Lu}"), F.upper(letter)).when(ch.rlike(r"[\p{L}\p{N}]"), letter).otherwise(ch)
        return F.when((at >= skip) & (at < keep), new).otherwise(ch)

    spelled = F.array_join(F.transform(F.split(value, ""), change), "")

    def further(n: Column) -> Column:
        code = byte_at(hexed, 128 - n)
        new = F.when(hexadecimal, pick(tuple("0123456789abcdef"), code))
        new = new.when(kind.isin("phone", "iban", "ssn", "card"), pick(tuple("0123456789"), code))
        new = new.otherwise(by_script(value, lambda s: pick(tuple(ALPHABETS[s]), code)))
        return F.when(n > 0, new).otherwise("")

    more = F.array_join(F.transform(F.sequence(F.lit(0), added), further), "")
    spelled = F.when(kind == "email", F.concat(more, spelled)).otherwise(F.concat(spelled, more))
    octets = F.transform(F.sequence(F.lit(0), added + 3), lambda n: (byte_at(hexed, n) % 254 + 1).cast("string"))
    octets = F.array_join(octets, ".")

    def made_up(syllables: Column) -> Column:
        def make(script: str) -> Column:
            parts = F.transform(F.sequence(F.lit(1), syllables), lambda n: pick(SYLLABLES[script], byte_at(hexed, n - 1)))
            return F.initcap(F.array_join(parts, ""))

        return by_script(value, make)

    def given(gender: str) -> Column:
        known = by_script(value, lambda s: pick(GIVEN[gender, s], byte_at(hexed, F.lit(0))))
        return F.when(attempt == 0, known).otherwise(made_up(attempt + 3))

    return (
        F.when(kind == "ip", octets)
        .when(kind == "given_f", given("f"))
        .when(kind == "given_m", given("m"))
        .when(kind == "given_n", made_up(attempt + 3))
        .when(kind == "surname", made_up(attempt + 4))
        .otherwise(spelled)
    )


def assign_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, new): one surrogate for each value, no two alike and none a value that occurs.

    Of values that drew the same surrogate the first in order keeps it and the others draw again, as do
    those that drew a real value; rounds go on until none is left.
    """
    spark = values.sparkSession
    values = as_table(values.distinct(), scratch_path(spark, "values"))
    draw = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)
    drawn = values.withColumn("attempt", F.lit(0)).withColumn("new", draw)
    settled, real = None, values.select("kind", F.lower("value").alias("folded")).distinct()
    while True:
        drawn = as_table(drawn, scratch_path(spark, "drawn"))
        first = Window.partitionBy("kind", "folded").orderBy("held", "value")
        every = drawn.withColumn("held", F.lit(1))
        if settled is not None:
            every = every.unionByName(settled.withColumn("held", F.lit(0)))
        every = every.withColumn("folded", F.lower("new"))
        every = every.withColumn("rank", F.row_number().over(first)).join(
            real.withColumn("is_real", F.lit(True)), ["kind", "folded"], "left"
        )
        good = (F.col("rank") == 1) & F.col("is_real").isNull()
        every = every.select("kind", "value", "attempt", "new", ((F.col("held") == 0) | good).alias("good"))
        every = as_table(every, scratch_path(spark, "checked"))
        settled = every.where("good").drop("good")
        bad = every.where("NOT good")
        if not bad.limit(1).count():
            return settled.select("kind", "value", "new")
        drawn = bad.select("kind", "value", (F.col("attempt") + 1).alias("attempt")).withColumn("new", draw)


def checked(form: Column, kind: Column) -> Column:
    """Whether check digits are right, those of cards (mod 10) and accounts (mod 97); others have none.

    Numbers that begin and are as long as an issuer's cards count without (mistyped ones are personal too). A
    pattern can take in one group of characters too many, so the form without its last group counts as well.
    """

    def card(text: Column) -> Column:
        number = F.regexp_replace(text, "[^0-9]", "")
        digits = F.split(F.reverse(number), "")

        def weighed(digit: Column, at: Column) -> Column:
            n = digit.cast("int")
            return F.when(at % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

        total = F.aggregate(F.transform(digits, weighed), F.lit(0), lambda total, n: total + n)
        return number.rlike(f"^(?:{ISSUERS})$") | (total % 10 == 0)

    def account(text: Column) -> Column:
        signs = F.upper(F.regexp_replace(text, " ", ""))
        signs = F.split(F.concat(F.substring(signs, F.lit(5), F.length(signs)), F.substring(signs, 1, 4)), "")

        def step(rest: Column, sign: Column) -> Column:
            digit = sign.rlike("[0-9]")
            return F.when(digit, rest * 10 + F.ascii(sign) - 48).otherwise(rest * 100 + F.ascii(sign) - 55) % 97

        return F.aggregate(signs, F.lit(0), step) == 1

    shorter = F.regexp_replace(form, "[ -][A-Z0-9]+$", "")
    return (
        F.when(kind == "card", card(form) | (F.length(shorter) > 12) & card(shorter))
        .when(kind == "iban", account(form) | (F.length(shorter) > 14) & account(shorter))
        .otherwise(True)
    )


def canonical(forms: DataFrame) -> DataFrame:
    """(form, place, kind, value, written): what a written form stands for, its writing aside.

    Names have up to two parts, ``written`` is the part's own writing. Forms with wrong check digits are left out.
    """
    form = F.col("form")
    forms = forms.withColumn("kind", kind_of(form)).where(checked(form, F.col("kind")))
    kind = F.col("kind")
    digits = F.regexp_replace(form, "[^0-9]", "")
    code = F.when(form.startswith("+"), F.regexp_extract(digits, f"^(?:{COUNTRY}|[0-9]{{3}})", 0))
    code = code.otherwise(F.regexp_extract(digits, "^0?", 0))
    hexadecimal = form.rlike("^[0-9A-Fa-f]+$")
    value = (
        F.when(kind.isin("email", "ip6"), F.lower(form))
        .when(kind == "phone", F.concat_ws(" ", code, F.substring(digits, F.length(code) + 1, F.length(digits))))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(form, " ", "")))
        .when((kind == "secret") & hexadecimal, F.lower(form))
        .otherwise(form)
    )
    words = F.regexp_extract_all(F.regexp_replace(form, f"^{TITLE} ", ""), F.lit(WORD), F.lit(0))
    gender = F.when(form.rlike("^(?i:" + "|".join(TITLES_F) + r")(?![\p{L}\p{N}])"), "given_f")
    gender = gender.when(form.rlike("^(?i:" + "|".join(TITLES_M) + r")(?![\p{L}\p{N}])"), "given_m").otherwise("given_n")

    def part(kind: Column, value: Column, written: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), written.alias("written"))

    surname = part(F.lit("surname"), F.lower(F.element_at(words, -1)), F.element_at(words, -1))
    first = part(gender, F.lower(F.element_at(words, 1)), F.element_at(words, 1))
    named = F.when(F.size(words) > 1, F.array(first, surname)).otherwise(F.array(surname))
    parts = F.when(kind == "name", named).otherwise(F.array(part(kind, value, form)))
    return forms.select("form", F.posexplode(parts).alias("place", "part")).select("form", "place", "part.*")


def one_gender(parts: DataFrame) -> DataFrame:
    """Given names after a title for both genders count as what another title tells about the same name."""
    known = parts.where(F.col("kind").isin("given_f", "given_m")).groupBy("value").agg(F.min("kind").alias("known"))
    neutral = parts.where(F.col("kind") == "given_n").join(known, "value", "left")
    neutral = neutral.withColumn("kind", F.coalesce("known", "kind")).select(*parts.columns)
    return parts.where(F.col("kind") != "given_n").unionByName(neutral)


def written_like(kind: Column, form: Column, new: Column) -> Column:
    """``new`` in the writing of ``form``: its letters and digits in the form's places and case, added ones outside."""
    letters = F.regexp_replace(new, r"[^\p{L}\p{N}]", "")
    is_capital = capitals(form)
    added = F.greatest(F.length(letters) - F.length(F.regexp_replace(form, r"[^\p{L}\p{N}]", "")), F.lit(0))
    before = F.when(kind == "email", added).otherwise(F.lit(0))

    def cut(at: Column, n: Column) -> Column:
        part = F.substring(letters, at, n)
        return F.when(is_capital, F.upper(part)).otherwise(part)

    start = F.struct(cut(F.lit(1), before).alias("out"), (before + 1).alias("at"))

    def step(done: Column, ch: Column) -> Column:
        mine = F.substring(letters, done["at"], F.lit(1))
        mine = F.when(is_capital | ch.rlike(r"\p{Lu}"), F.upper(mine)).otherwise(mine)
        is_letter = ch.rlike(LETTER)
        out = F.concat(done["out"], F.when(is_letter, mine).otherwise(ch))
        return F.struct(out.alias("out"), (done["at"] + is_letter.cast("int")).alias("at"))

    behind = cut(F.length(letters) - added + 1, added)
    return F.aggregate(F.split(form, ""), start, step, lambda x: F.concat(x["out"], F.when(before == 0, behind).otherwise("")))


def in_case(written: Column, new: Column) -> Column:
    return F.when(capitals(written), F.upper(new)).otherwise(new)


def filled(gaps: Column, between: Column) -> Column:
    """A text from its gaps and what goes between them."""
    both = F.zip_with(gaps, F.concat(between, F.array(F.lit(""))), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    return F.array_join(both, "")


def replace_personal_data(
    docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", out_col: str | None = None
) -> DataFrame:
    """``docs`` with personal data in the text replaced, in all its columns and rows.

    Found are e-mail and IP addresses (both versions), phone, card, social security and bank account numbers,
    secrets (after a telling word: quoted ones with a letter or digit, others with both; long hexadecimal
    strings, known shapes of keys, signed web tokens, blocks of private keys) and names after a title. A surrogate is a keyed hash of what the entity stands for, so the same entity has the same
    surrogate wherever and however it is written; it has the kind, length, alphabet, case and separators
    of what it replaces, names the gender and script, addresses their last label, phones the country
    code. Surrogates of different entities differ and are no entity of the input: all drawn ones are
    checked against each other and against those found. A value for which draws of its length find
    nothing free gets a longer surrogate.

    Where someone is named after a title, the words of the name are replaced wherever they stand in that
    document, with or without the title, before a genitive and in capitals too, by the same surrogates.
    Initials and particles ("de la") of a name stay. Numbers of accounts, and of cards that are not like an
    issuer's, count only with right check digits, dotted numbers not after a word for a version.

    Only distinct forms are worked on. Texts cross the network once, to meet their own surrogates.
    With ``out_col`` the new text goes to a column of that name, and ``n_entities`` counts are added; columns
    of ``docs`` with these names give way to them.

    Null and empty texts stay as they are, null ids too. Repeated rows repeat. An empty table gives an
    empty one. The text is cut at the entities only; memory follows the longest text.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    keys = ["_pii_row", "_pii_text"]
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    bare = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda f: F.struct(f.alias("form"), F.lit("").alias("word")))
    wide = F.zip_with(
        F.regexp_extract_all(text, F.lit(WIDE), F.lit(0)),
        F.regexp_extract_all(text, F.lit(WIDE), F.lit(1)),
        lambda f, w: F.struct(f.alias("form"), w.alias("word")),
    )
    found = F.when(hinted & text.rlike(KINDS["name"]), wide).when(hinted, bare)
    row = [key.alias(name) for key, name in zip(row_keys(id_col, F.coalesce(text, F.lit(""))), keys)]
    seen = docs.select(*row, found.alias("found")).where(F.size("found") > 0)
    seen = as_table(seen, scratch_path(spark, "forms"))
    forms = seen.select(F.explode("found").alias("use")).where("use.word = ''").select("use.form").distinct()
    parts = as_table(canonical(forms), scratch_path(spark, "parts"))
    parts = as_table(one_gender(parts), scratch_path(spark, "gendered"))
    new = assign_surrogates(parts.select("kind", "value"), key)
    spelled = parts.join(new, ["kind", "value"])
    is_name, as_written = F.col("kind").isin(*NAMES), written_like(F.col("kind"), F.col("written"), F.col("new"))
    as_written = F.when(F.col("kind") == "ip", F.col("new")).when(~is_name, as_written).otherwise(in_case(F.col("written"), F.col("new")))
    spelled = spelled.select("form", F.struct("place", as_written.alias("new"), is_name.alias("is_name")).alias("part"))
    spelled = spelled.groupBy("form").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    news = F.col("parts")["new"]
    title = F.regexp_extract("form", f"^{TITLE} ", 0)
    gaps = F.split(F.substring(F.col("form"), F.length(title) + 1, F.length("form")), WORD, -1)
    whole = F.when(F.col("parts")[0]["is_name"], F.concat(title, filled(gaps, news))).otherwise(news[0])
    mapping = spelled.select("form", whole.alias("new"))

    uses = seen.dropDuplicates(keys).select(*keys, F.posexplode("found").alias("at", "use")).select(*keys, "at", "use.*")
    entities = uses.where("word = ''").join(mapping, "form", "left")
    titled = uses.where((F.col("word") == "") & F.col("form").rlike(f"^{TITLE} ")).select(*keys, "form")
    names = titled.join(parts.where(is_name).select("form", "kind", "value"), "form")
    names = names.groupBy(*keys, "value").agg(F.max("kind").alias("kind")).join(new, ["kind", "value"])
    mentions = uses.where("word <> ''").withColumn("value", F.lower("word")).join(names, [*keys, "value"], "left")
    mentions = mentions.withColumn("new", in_case(F.col("word"), F.col("new")))
    use = F.struct("at", F.coalesce("new", "form").alias("new"), F.col("new").isNotNull().alias("hit")).alias("use")
    every = entities.select(*keys, use).unionByName(mentions.select(*keys, use))
    every = every.groupBy(*keys).agg(F.sort_array(F.collect_list("use")).alias("_new"))

    joined = docs.select(whole_row(docs), *row).join(every, keys, "left")
    text = F.col("_doc").getField(text_col).cast("string")
    between = F.when(text.rlike(KINDS["name"]), F.split(text, WIDE, -1)).otherwise(F.split(text, ENTITY, -1))
    replaced = F.when(F.col("_new").isNotNull(), filled(between, F.col("_new")["new"])).otherwise(text)
    if out_col is None:
        own = [replaced.alias(c) if c == text_col else x for c, x in zip(docs.columns, columns_of(docs))]
        return joined.select(*own)
    count = F.size(F.filter(F.coalesce("_new", F.array().cast(joined.schema["_new"].dataType)), lambda u: u["hit"])).cast("long")
    own = [x for c, x in zip(docs.columns, columns_of(docs)) if c not in (out_col, "n_entities")]
    return joined.select(*own, replaced.alias(out_col), count.alias("n_entities"))
