"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Detected: e-mail addresses, phone numbers, payment cards, social security numbers, IBANs, IPv4, IPv6
and MAC addresses, access keys, signed web tokens, private keys in PEM form, passwords and tokens that are assigned, and names after a title or
beginning with a known given name. Every distinct entity of the corpus gets one surrogate, derived
from a secret key, so all its mentions stay alike in every document (coreference); spellings of one
entity (separators of a number, case of an address, a surname alone or with its given name) share
it. A surrogate keeps type and format: digits stay digits, letters letters of their script and case,
separators stay; country codes, the card brand's leading digits, valid check digits of cards and IBANs, the ranges of octets and of the parts of a
social security number, markers of keys and the last label of a domain are kept; given names keep their gender and script. A name runs over initials, particles
and any further capitalised parts, the last of which is the surname; particles stay, initials become
other letters, which need not be distinct. Dates of birth are no entities: the calendar has too few days for
distinct surrogates in a large corpus.

Distinctness is checked over the whole corpus: a candidate that equals an entity of the corpus, or a
surrogate already given, or that two entities would share, is drawn again with the next number of the
key stream, until none is left. Texts without entities pass straight through; in the others a mention
joins its surrogate, hot entities by a bounded broadcast.

Defined results: a null text stays null and an empty one empty, both with no entity; rows that agree
in id and text are treated alike; an empty table gives an empty result; other columns pass through
whatever their names, and the count takes the next free name where the table has n_entities. A name with neither a title nor a known given name is not detected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, free_names, fresh, join_groups, keys, spread, table
from lexmill.llm.exact_dedup import flag_repeats, n_blocks, repeated_cells
from lexmill.llm.line_dedup import FILTER_MB

#: Only for tests and examples; pass your own.
KEY = "example key"

# Titles and given names by gender and script.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Don Signor господин г-н".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Doña Signora госпожа г-жа".split()
OTHER_TITLES = "Dr Prof Professor доктор".split()
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Hans Klaus Jürgen Pierre Jean-Luc José Carlos Miguel".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Emily Michelle Laura Helen Anna Ursula Greta Sophie Camille María Carmen Lucía Elena".split()
MALE_CYRILLIC = "Иван Александр Сергей Дмитрий Алексей Николай Михаил Владимир Павел Пётр".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split()
SYLLABLES = "bar ben cor dal den far gar hal ken lan mar mer nor pel ran sel tor val win zar".split()
SYLLABLES_CYRILLIC = "бар бел вор гор дан зар кор лан мар мир нов пол рам сол тар хор".split()

_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
_INITIAL = r"(?:(?:\p{Lu}\.){1,4}|\p{Lu})"
#: Parts of names that stay.
PARTICLES = "van von der den de la le du da di do dos das del della bin ibn al el ter ten zu zur zum af av y e i".split()
#: What a name may have before its surname, and the surname.
_RUN = rf"(?:(?:{_NAME}|{_INITIAL}|{'|'.join(PARTICLES)}) ){{0,15}}{_NAME}"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Forms that tell their type by themselves, in the order in which they are tried.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]{16,16000}+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{5,8000}+\.[A-Za-z0-9_-]{5,8000}+\.[A-Za-z0-9_-]{5,2000}",
    "access": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "ipv6": rf"(?={_HEX}:)(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:))",
    "mac": r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}",
    "ipv4": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4} [0-9]{5,8}|0[0-9]{1,4}(?: [0-9]{2,4}){2,4}",
}
_ASSIGNED = r"(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key)\"?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/=.~-]{6,1024}"
_TITLED = rf"(?:(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.? ){{1,3}}{_RUN}"
_GIVEN = rf"(?:{'|'.join(MALE + FEMALE + MALE_CYRILLIC + FEMALE_CYRILLIC)}) {_RUN}"
#: Everything that is detected; it begins where no letter or digit goes before. Cheap looks at the next or
#: the last characters come before what they rule out, so most words fail at once.
_BY_FIRST = {r"[0-9(+]": ("ipv4", "ssn", "card", "phone"), "[A-Z]": ("access", "iban")}
_FIRSTS = "|".join(f"(?={first})(?:{'|'.join(FORMS[n] for n in names)})" for first, names in _BY_FIRST.items())
ENTITY = (
    rf"(?<![\p{{L}}\p{{N}}_])(?:{FORMS['pem']}|{FORMS['jwt']}|(?<=[=:\"']|[=:]\s|[=:]\s\s){_ASSIGNED}|{FORMS['email']}|{FORMS['ipv6']}|{FORMS['mac']}|{_FIRSTS}"
    rf"|(?=[\p{{Lu}}гд])(?:{_TITLED}|{_GIVEN}))(?![\p{{L}}\p{{N}}_])"
)

#: Draws that keep the format; later ones may grow, so that even a small space never runs out.
DRAWS = 6


def kind_of(raw: Column) -> Column:
    """The type of an entity by its form; what has none was assigned to a secret's name."""
    found = F.when(raw.rlike(f"^(?:{_TITLED}|{_GIVEN})$"), "person")
    for name, form in FORMS.items():
        found = found.when(raw.rlike(f"^(?:{form})$"), name)
    return found.otherwise("secret")


def parts_of(raw: DataFrame) -> DataFrame:
    """(raw, at, kind, piece, canon): the parts of an entity that get a surrogate each, or stay (kind null)."""
    typed = raw.withColumn("whole", kind_of(F.col("raw")))
    pieces = typed.select("raw", "whole", F.posexplode(F.when(F.col("whole") == "person", F.split("raw", " ")).otherwise(F.array("raw"))).alias("at", "piece"), F.size(F.split("raw", " ")).alias("n"))
    first = F.regexp_replace(F.element_at(F.split("raw", " "), 1), r"\.$", "")
    titled = F.col("raw").rlike(rf"^(?:{_TITLED})$")
    title = titled & (F.col("at") < F.col("n") - 1) & F.regexp_replace("piece", r"\.$", "").isin(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
    given = F.col("at") < F.col("n") - 1
    male = F.when(titled, first.isin(MALE_TITLES)).otherwise(F.col("piece").isin(MALE + MALE_CYRILLIC))
    female = F.when(titled, first.isin(FEMALE_TITLES)).otherwise(F.col("piece").isin(FEMALE + FEMALE_CYRILLIC))
    person = F.when(title | F.col("piece").isin(PARTICLES), F.lit(None).cast("string")).when(F.col("piece").rlike(f"^{_INITIAL}$"), "initial").when(given & male, "male").when(given & female, "female").when(given, "given").otherwise("surname")
    kind = F.when(F.col("whole") == "person", person).otherwise(F.col("whole"))
    digits = F.regexp_replace("piece", "[^0-9]", "")
    canon = (
        F.when(kind == "email", F.lower("piece"))
        .when(kind == "phone", F.when(F.length(digits) >= 10, F.expr("right(regexp_replace(piece, '[^0-9]', ''), 10)")).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "ipv6", F.lower("piece"))
        .when(kind.isin("iban", "mac"), F.upper(F.regexp_replace("piece", "[ :-]", "")))
        .otherwise(F.col("piece"))
    )
    return pieces.select("raw", "at", kind.alias("kind"), "piece", canon.alias("canon"))


def _stream(key: str, kind: str, canon: str, draw: str) -> Column:
    """The key stream of an entity: 256 hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), F.col(kind), F.col(canon), F.col(draw).cast("string"))
    return F.concat(F.sha2(F.concat(F.lit("a"), seed), 512), F.sha2(F.concat(F.lit("b"), seed), 512))


def _number(stream: Column, i: Column | int, mod: int) -> Column:
    """The i-th number below mod (at most 4096) that the stream gives."""
    at = (F.lit(i) if isinstance(i, int) else i) % 125
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(4)), 16, 10).cast("int") % mod


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), i % len(words) + 1)


def _alike(text: str, stream: str) -> Column:
    """Each digit and letter of a text replaced by another of its kind."""
    s, chars = F.col(stream), F.split(F.col(text), "")

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), _number(s, i, 10) + 1, F.lit(1)))
        for low, high in (("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")):
            cyrillic = c.rlike(r"\p{IsCyrillic}")
            there = cyrillic if low[0] == "а" else ~cyrillic
            for letters, case in ((low, r"\p{Ll}"), (high, r"\p{Lu}")):
                out = out.when(there & c.rlike(case), F.substring(F.lit(letters), _number(s, i, len(letters)) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """The sum by which a card number is checked; the last digit is the check digit."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10


def _iban_sum(canon: Column) -> Column:
    """A number of a country, check digits and account modulo 97; 1 if it is valid."""
    moved = F.split(F.concat(F.substring(canon, 5, 64), F.substring(canon, 1, 4)), "")
    return F.aggregate(moved, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _name(kind: Column, canon: Column, s: Column) -> Column:
    """A given name of the gender and script, or a surname of the script."""
    cyrillic = canon.rlike(r"\p{IsCyrillic}")

    def surname(syllables: list[str]) -> Column:
        return F.initcap(F.concat(*[_pick(syllables, _number(s, 4 * k, 4096)) for k in range(4)]))

    def given(words: list[str], syllables: list[str]) -> Column:
        return F.concat(_pick(words, _number(s, 0, 4096)), F.when(F.col("draw") > 0, F.concat(F.lit("-"), F.initcap(F.concat(*[_pick(syllables, _number(s, 4 * k + 2, 4096)) for k in range(3)])))).otherwise(""))

    male = F.when(cyrillic, given(MALE_CYRILLIC, SYLLABLES_CYRILLIC)).otherwise(given(MALE, SYLLABLES))
    female = F.when(cyrillic, given(FEMALE_CYRILLIC, SYLLABLES_CYRILLIC)).otherwise(given(FEMALE, SYLLABLES))
    either = F.when(cyrillic, given(MALE_CYRILLIC + FEMALE_CYRILLIC, SYLLABLES_CYRILLIC)).otherwise(given(MALE + FEMALE, SYLLABLES))
    return F.when(kind == "male", male).when(kind == "female", female).when(kind == "given", either).otherwise(F.when(cyrillic, surname(SYLLABLES_CYRILLIC)).otherwise(surname(SYLLABLES)))


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, draw) with the surrogate that the key gives at this draw."""
    df = entities.withColumn("stream", _stream(key, "kind", "canon", "draw")).withColumn("alike", _alike("canon", "stream"))
    s, canon, alike, kind = F.col("stream"), F.col("canon"), F.col("alike"), F.col("kind")

    def octet(k: int) -> Column:
        x = F.element_at(F.split(canon, r"\."), k + 1)
        v = F.when(F.col("draw") >= DRAWS, _number(s, 4 * k, 256)).when(F.length(x) == 3, 100 + _number(s, 4 * k, 156)).when(F.length(x) == 2, 10 + _number(s, 4 * k, 90)).otherwise(_number(s, 4 * k, 10))
        return v.cast("string")

    last = F.regexp_extract(canon, r"(\.[a-z]+)$", 1)
    body = F.substring(alike, F.lit(1), F.length(alike) - 1)
    fit = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    off = F.when(_luhn(canon) == 0, 0).otherwise(1 + _number(s, 101, 9))
    brand = F.when(canon.startswith("4"), 1).when(canon.rlike("^(?:2|30|35|60|64)"), 4).otherwise(2)
    card = F.concat(F.substring(canon, F.lit(1), brand), F.substring(body, brand + 1, F.lit(64)))
    account = F.substring(alike, 5, 64)
    check = F.lpad((98 - _iban_sum(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    area = 1 + _number(s, 0, 898)
    area = F.when(canon.startswith("9"), 900 + _number(s, 0, 100)).otherwise(area + F.when(area >= 666, 1).otherwise(0))
    ssn = F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (1 + _number(s, 4, 99), 2), (1 + _number(s, 8, 9999), 4))])
    begin, end = (F.regexp_extract(canon, f"-----{word} [A-Z ]*-----", 0) for word in ("BEGIN", "END"))
    fit_card = (10 - _luhn(F.concat(card, F.lit("0")))) % 10
    hexes = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _number(s, i, 16) + 1, F.lit(1))).when(c.rlike("[A-F]"), F.substring(F.lit("0123456789ABCDEF"), _number(s, i, 16) + 1, F.lit(1))).otherwise(c)), "")
    more = F.when(F.col("draw") < DRAWS, "").otherwise(F.expr("right(conv(substring(stream, 200, 8), 16, 10), 5)"))
    room = (F.col("draw") >= DRAWS) & canon.contains("::") & (F.size(F.split(canon, ":")) < 7)
    longer = F.when(room, F.concat(F.when(canon.endswith(":"), "").otherwise(":"), F.substring(s, 200, 4))).otherwise("")
    made = (
        F.when(kind == "email", F.concat(F.regexp_extract(alike, r"^([^@]*)@", 1), more, F.lit("@"), F.substring_index(F.substring(alike, F.lit(1), F.length(alike) - F.length(last)), "@", -1), last))
        .when(kind == "access", F.concat(F.substring(canon, 1, 4), F.substring(alike, 5, 64), more))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.when(_iban_sum(canon) == 1, check).otherwise(F.substring(alike, 3, 2)), account))
        .when(kind == "ssn", ssn)
        .when(kind == "jwt", F.concat(F.lit("eyJ"), F.substring(alike, 4, 20_000)))
        .when(kind == "pem", F.concat(begin, F.substring(alike, F.length(begin) + 1, F.length(alike) - F.length(begin) - F.length(end)), end))
        .when(kind == "mac", F.upper(F.substring(s, F.lit(1), F.length(canon))))
        .when(kind == "ipv4", F.concat_ws(".", *[octet(k) for k in range(4)]))
        .when(kind == "card", F.concat(card, ((fit_card + off) % 10).cast("string")))
        .when(kind == "ipv6", F.concat(F.substring_index(canon, ":", 1), F.substring(hexes, F.length(F.substring_index(canon, ":", 1)) + 1, F.lit(64)), longer))
        .when((kind == "phone") & canon.startswith("0"), F.concat(F.lit("0"), F.substring(alike, 2, 64)))
        .when(kind == "phone", F.concat(F.when(alike.rlike("^[01]"), (2 + _number(s, 100, 8)).cast("string")).otherwise(F.substring(alike, 1, 1)), F.substring(alike, 2, 64)))
        .when((kind == "secret") & canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.concat(hexes, more))
        .when(kind.isin("male", "female", "given", "surname"), F.concat(_name(kind, canon, s), F.when(F.col("draw") < DRAWS, "").otherwise(F.translate(more, "0123456789", "abcdefghij"))))
        .otherwise(F.concat(alike, F.when(kind == "secret", more).otherwise("")))
    )
    return df.select("kind", "canon", "draw", made.alias("surrogate"))


def assign(entities: DataFrame, key: str, most: int = 64) -> DataFrame:
    """(kind, canon, surrogate): distinct surrogates, none of which is an entity itself.

    A round settles, of the entities that would share a surrogate, the first; the others draw again.
    """
    todo, settled = entities.select("kind", "canon").withColumn("draw", F.lit(0)), None
    taken = entities.select(F.lower("canon").alias("form"))
    for _ in range(most):
        drawn = cut(draw_surrogates(todo, key).withColumn("form", F.lower("surrogate")))
        free = drawn.join(taken, "form", "left_anti")
        best = free.groupBy("form").agg(F.min(F.struct("kind", "canon", "draw", "surrogate")).alias("x")).select("x.*", "form")
        best = cut(best)
        settled = best if settled is None else settled.unionByName(best)
        todo = cut(drawn.join(best, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("draw") + 1).alias("draw")))
        if todo.isEmpty():
            return settled.select("kind", "canon", "surrogate")
        taken = entities.select(F.lower("canon").alias("form")).union(settled.select("form"))
    raise RuntimeError(f"no distinct surrogates after {most} draws; entities of a type exceed what its format can hold")


def rendered(pieces: DataFrame) -> DataFrame:
    """pieces (piece, canon, surrogate, kind) with the surrogate in the form of the piece."""
    plain = F.col("kind").isNull() | ~F.col("kind").isin("phone", "card", "ssn", "iban", "mac", "email")
    kept = F.length(F.regexp_replace("piece", "[^A-Za-z0-9]", "")) - F.length("canon")  # country code before a phone's number
    chars = F.split("piece", "")
    turn = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substring(F.col("piece"), F.lit(1), i + 1), "[^A-Za-z0-9]", "")))

    def one(c: Column, n: Column) -> Column:
        new = F.substring(F.col("surrogate"), n - kept, F.lit(1))
        return F.when(~c.rlike("[A-Za-z0-9]") | (n <= kept), c).when(c.rlike("[a-z]"), F.lower(new)).otherwise(new)

    formed = F.array_join(F.zip_with(chars, turn, one), "")
    mail = F.when(F.col("piece").rlike("[a-z]") | ~F.col("piece").rlike("[A-Z]"), F.col("surrogate")).otherwise(F.upper("surrogate"))
    hexes = F.when(F.col("piece").rlike("[A-F]") & ~F.col("piece").rlike("[a-f]"), F.upper("surrogate")).otherwise(F.col("surrogate"))
    return pieces.withColumn("new", F.when(F.col("surrogate").isNull(), F.col("piece")).when(F.col("kind") == "email", mail).when(F.col("kind") == "ipv6", hexes).when(plain, F.col("surrogate")).otherwise(formed))


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(raw, n, new): what replaces each distinct mention (raw, n)."""
    parts = parts_of(mentions.select("raw")).withColumn("draw", F.lit(0)).withColumn("stream", _stream(key, "kind", "canon", "draw"))
    initial = F.coalesce(F.col("kind") == "initial", F.lit(False))  # another letter; there are too few for distinct ones
    parts = cut(parts.select("raw", "at", F.when(~initial, F.col("kind")).alias("kind"), F.when(initial, _alike("piece", "stream")).otherwise(F.col("piece")).alias("piece"), "canon"))
    entities = parts.where("kind is not null").select("kind", "canon").distinct()
    given = parts.join(assign(cut(entities), key), ["kind", "canon"], "left")
    whole = rendered(given).groupBy("raw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new"))  # a name's parts
    return mentions.join(whole, "raw")


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with all entities replaced, and their number n_entities."""
    a, b, new, flag = fresh(docs.columns, "key", "times", "new", "has")
    text = F.col(f"`{text_col}`")
    k1, k2 = keys(id_col, text_col)
    has = F.coalesce(text.rlike(ENTITY), F.lit(False))
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    spots = cut(docs.where(has).select(k1.alias("k1"), k2.alias("k2"), found.alias("raws")).select("k1", "k2", F.posexplode("raws").alias("at", "raw")))
    known = cut(replacements(spots.groupBy("raw").agg(F.count(F.lit(1)).alias("n")), key))
    placed = join_groups(spots, known, "raw", "n", spots.count())
    per_doc = placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "new"))).alias(new), F.count_if(F.col("at") == 0).alias(b))  # a document's own mentions, its rows
    per_doc = cut(per_doc.select(F.struct("k1", "k2").alias(a), F.transform(new, lambda x: x["new"]).alias(new), b))
    blocks = n_blocks(per_doc.count(), 16, FILTER_MB)
    flagged = flag_repeats(docs.withColumn(a, F.struct(k1.alias("k1"), k2.alias("k2"))), a, repeated_cells(per_doc, a, blocks, 1), blocks, flag)  # spares a second search of all texts
    hit = join_groups(flagged.where(F.col(flag)), per_doc, a, b, docs.count(), "left")
    done = F.array_join(F.zip_with(F.split(text, ENTITY, -1), F.col(new), lambda s, e: F.concat(s, F.coalesce(e, F.lit("")))), "")
    columns = [F.when(F.col(new).isNull(), text).otherwise(done).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    (count,) = free_names(docs.columns, "n_entities")
    changed = hit.select(*columns, F.coalesce(F.size(new), F.lit(0)).cast("long").alias(count))
    same = flagged.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias(count))
    return same.unionByName(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
