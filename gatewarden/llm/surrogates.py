"""PII surrogates: detected entities get keyed, type-consistent replacements; DataFrame functions only.

One pattern finds all kinds of entity; a name found with a title is then also found without one in the same document. Each entity's canonical form (kind and letters or digits) is hashed
with a key; the hash deals new letters and digits, character by character, and what it deals is set into the format of each spelling, so
that case, script (Latin, Greek, Cyrillic), separators and length stay. A surrogate's canonical form depends on the canonical form alone: however an entity is spelt, it is replaced by one and
the same (coreference). Numbers that pass a check sum pass it afterwards; given names keep the gender that the lists give them, others get a name
that suits any title; prefixes by which credentials are known stay. Collisions are checked over
all documents: where two canonical forms would get one surrogate, or a surrogate is an entity of the corpus, those concerned are hashed anew with a
higher attempt, until none collide (distinctness); from the eighth attempt on names and addresses grow by a letter, so that short ones don't run out.

A null text stays null, with no entities. Repeated rows are treated alike. Columns other than the text are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа", "госпожа", "Κυρία", "κυρία")
MALE = ("Mr", "Herr", "Señor", "Monsieur", "Господин", "господин", "Κύριος", "κύριος")
TITLE = rf"(?:{'|'.join((*FEMALE, *MALE, 'Dr', 'Prof'))})\.? "
#: What credentials start with, and what stays of them; after their issuers' documentation.
PREFIXES = r"AKIA|ASIA|AIza|gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|npm_|(?:sk|rk|pk)_(?:test|live)_|whsec_|(?i:aws_secret_access_key)\s*[=:]\s*[\"']?|(?i:AccountKey)=|(?i:postgres(?:ql)?|mysql2?|mongodb(?:\+srv)?|redis|amqp)://|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----|eyJ"
CREDENTIALS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"AIza[0-9A-Za-z_-]{35}",
    r"(?:gh[oprsu]_|npm_)[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}",
    r"(?:(?:sk|rk|pk)_(?:test|live)_|whsec_)[A-Za-z0-9]{16,}",
    r"(?i:aws_secret_access_key)\s*[=:]\s*[\"']?[A-Za-z0-9/+=]{40}",
    r"(?i:AccountKey)=[A-Za-z0-9+/]{86}==",
    r"(?i:postgres(?:ql)?|mysql2?|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:[^\s@]+@[^\s\"']+",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----",
)
#: kind -> pattern, in the order in which they are tried at a place
KINDS = {
    "credential": rf"(?<![\w-])(?=(?:{PREFIXES}))(?:{'|'.join(CREDENTIALS)})",
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w.]*[0-9])",
    "ssn": r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:[0-9][ -]?){12,18}[0-9](?![\w-])",
    "phone": r"(?<![\w+])(?:\+(?=(?:[ .()-]*[0-9]){7})[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}_]){TITLE}\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?![\p{{L}}\p{{N}}_])",
}
#: first character -> kinds that can start with it
STARTS = {
    "[a-z]": ("credential", "email", "secret"),
    "[A-Z]": ("credential", "email", "iban", "secret", "name"),
    "[0-9]": ("email", "secret", "ip", "ssn", "card", "phone"),
    "[+(]": ("phone",),
    "-": ("credential",),
    "[гГκΚ]": ("name",),
}
#: No kind starts after an ASCII letter or digit; said once, it spares most places the alternatives.
ANY = "(?<![0-9A-Za-z])(?:" + "|".join(f"(?={start})(?:{'|'.join(KINDS[k] for k in kinds)})" for start, kinds in STARTS.items()) + ")"
GIVEN = {
    "f": ("Anna", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Maria", "Nina", "Paula", "Rosa", "Sofia", "Teresa", "Vera", "Alice", "Emma"),
    "m": ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Victor", "Walter"),
    "": ("Alex", "Ariel", "Charlie", "Chris", "Dana", "Jamie", "Kim", "Luca", "Morgan", "Nicola", "Robin", "Sam", "Sascha", "Taylor", "Toni", "Yael"),
}
#: Letters by script and case; a letter is replaced by one of its own alphabet.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: Country codes of one digit and of two, as the numbering plan has them; all others have three.
CODES = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([k for k in KINDS.items() if k[0] != "name"]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What counts as the same entity: e-mail addresses and hexadecimal secrets in lower case, numbers by their digits (of phones, a + too), names by their words without the title."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.concat(
        kind,
        F.lit(":"),
        F.when(kind.isin("email", "secret"), F.lower(entity))
        .when(kind.isin("ssn", "card"), digits)
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "name", F.regexp_replace(entity, f"^{TITLE}", ""))
        .otherwise(entity),
    )


def entities_of(text: Column) -> Column:
    """All entities of a text in order of place, as spelt; names found with a title (and two words) also where they stand without."""

    def found(first: Column) -> Column:
        names = F.filter(F.transform(F.filter(first, lambda e: e.rlike(f"^{TITLE}")), lambda e: F.regexp_replace(e, f"^{TITLE}", "")), lambda n: n.contains(" "))
        return F.when(F.size(names) == 0, first).otherwise(F.regexp_extract_all(text, with_names(names), F.lit(0)))

    return bound(F.regexp_extract_all(text, F.lit(ANY), 0), found)


def with_names(names: Column) -> Column:
    """ANY, and before it each of names (letters and a blank alone) as a whole."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), F.array_join(F.array_distinct(names), "|"), F.lit(r")(?![\p{L}\p{N}_])|" + ANY))


def bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _draw(seed: Column, i, n) -> Column:
    """A number under n for place i; seed is a keyed digest."""
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n) if isinstance(n, int) else n).cast("int")


def _alphabet(c: Column) -> Column:
    """The letters or digits among which a character's replacement is chosen; empty for what stays as it is."""
    out = F.when(c.rlike("[0-9]"), "0123456789")
    for letters in ALPHABETS:
        out = out.when(F.instr(F.lit(letters), c) > 0, letters)
    for lower, upper, script in ((2, 3, "IsCyrillic"), (4, 5, "IsGreek"), (0, 1, "L")):  # accented letters
        out = out.when(c.rlike(rf"[\p{{Ll}}&&\p{{{script}}}]"), ALPHABETS[lower]).when(c.rlike(rf"[\p{{Lu}}&&\p{{{script}}}]"), ALPHABETS[upper])
    return out.otherwise("")


def _dealt(seed: Column, text: Column, keep=0) -> Column:
    """text with new letters and digits but for the first keep; what a place gets depends on how many letters and digits stand before it, not on separators."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        new = lambda al: F.when((al == "") | (a["i"] < keep), c).otherwise(F.substring(al, _draw(seed, a["i"], F.length(al)) + 1, F.lit(1)))
        return bound(_alphabet(c), lambda al: F.struct(F.concat(a["s"], new(al)).alias("s"), (a["i"] + (al != "").cast("int")).alias("i")))

    return F.aggregate(chars, zero, step, lambda a: a["s"])


def _checked(entity: Column, dealt: Column) -> Column:
    """dealt with its last digit set so that the number passes the check sum if entity does: of ten, the one that Luhn accepts; else one that it refuses."""
    luhn = lambda x: F.call_function("luhn_check", x)

    def done(d: Column) -> Column:
        fits = F.filter(F.split(F.lit("0,1,2,3,4,5,6,7,8,9"), ","), lambda x: luhn(F.concat(F.substring(d["digits"], F.lit(1), F.length(d["digits"]) - 1), x)) == d["good"])
        last = bound(fits, lambda f: F.element_at(f, (F.substring(d["digits"], F.length(d["digits"]), F.lit(1)).cast("int") % F.size(f)) + 1))
        return F.concat(F.substring(d["dealt"], F.lit(1), F.length(d["dealt"]) - 1), last)

    good = luhn(F.regexp_replace(entity, "[^0-9]", "")).alias("good")
    return bound(dealt, lambda d: bound(F.struct(d.alias("dealt"), F.regexp_replace(d, "[^0-9]", "").alias("digits"), good), done))


def _mod97(text: Column) -> Column:
    turned = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))


def _iban(seed: Column, entity: Column) -> Column:
    """Country and groups stay, the rest is dealt anew, and check digits make the remainder what it was: 1 for a valid number."""
    country, good = F.substring(entity, 1, 2), _mod97(F.replace(entity, F.lit(" "), F.lit(""))) == 1
    zero = lambda rest: _mod97(F.concat(country, F.lit("00"), F.replace(rest, F.lit(" "), F.lit(""))))
    digits = lambda rest: F.lpad((98 - zero(rest) + F.when(good, 0).otherwise(1)).cast("string"), 2, "0")
    return bound(_dealt(seed, F.substring(entity, F.lit(5), F.length(entity))), lambda rest: F.concat(country, digits(rest), rest))


def _name(seed: Column, entity: Column, extra: Column) -> Column:
    """Title as it is; of two words a given name of the gender that the lists give the first, else one that suits any title, and a dealt surname; a single word, and other scripts, are dealt."""
    title = F.regexp_extract(entity, f"^({TITLE})", 1)

    def of(w: Column) -> Column:
        first, last = F.get(w, F.lit(0)), F.get(w, F.size(w) - 1)
        lists = [F.array(*map(F.lit, GIVEN[g])) for g in ("f", "m", "")]
        known = F.when(first.isin(*GIVEN["f"]), lists[0]).when(first.isin(*GIVEN["m"]), lists[1]).otherwise(lists[2])
        latin = first.rlike(r"^[\x41-ɏ]+$") & (F.size(w) > 1)
        given = F.when(latin, F.element_at(known, _draw(seed, 0, 16) + 1)).when(F.size(w) > 1, _dealt(seed, first))
        return F.concat(title, F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), _dealt(F.concat(seed, F.lit("#")), F.concat(last, F.repeat(F.right(last, F.lit(1)), extra))))

    return bound(F.split(F.regexp_replace(entity, f"^{TITLE}", ""), " "), of)


def _credential(seed: Column, entity: Column) -> Column:
    """What a credential is known by stays (prefix, the parts of a web token, the last line of a key, padding); the rest is dealt."""
    token = F.array_join(F.transform(F.split(entity, r"\."), lambda p, i: F.concat(F.when(p.startswith("eyJ"), "eyJ").otherwise(""), _dealt(F.concat(seed, i.cast("string")), F.regexp_replace(p, "^eyJ", "")))), ".")
    prefix, suffix = F.regexp_extract(entity, f"^({PREFIXES})", 1), F.regexp_extract(entity, r"(-----END (?:[A-Z]+ )*PRIVATE KEY-----|=+)?$", 1)
    middle = F.substring(entity, F.length(prefix) + 1, F.length(entity) - F.length(prefix) - F.length(suffix))
    return F.when(entity.startswith("eyJ"), token).otherwise(F.concat(prefix, _dealt(seed, middle), suffix))


def surrogate(kind: Column, entity: Column, same: Column, attempt: Column, key: str) -> Column:
    """The replacement of entity, whose canonical form is same, at an attempt."""

    def made(b: Column) -> Column:
        kind, entity, seed = b["kind"], b["entity"], b["seed"]
        extra = F.greatest(F.lit(0), b["attempt"] - 7).cast("int")
        lower, at, tld = F.lower(entity), F.instr(entity, "@"), F.regexp_extract(entity, r"(\.[A-Za-z]{2,})$", 1)
        local = F.concat(F.repeat(F.lit("a"), extra), F.substring(lower, F.lit(1), at - 1))
        email = F.concat(_dealt(seed, local), F.lit("@"), _dealt(F.concat(seed, F.lit("@")), F.substring(lower, at + 1, F.length(entity) - at - F.length(tld))), F.lower(tld))
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
        ssn = F.concat((_draw(seed, 0, 565) + 101).cast("string"), F.lit("-"), F.lpad((_draw(seed, 1, 99) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((_draw(seed, 2, 9999) + 1).cast("string"), 4, "0"))
        hexa = F.substring(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256)), F.lit(1), F.length(entity))
        secret = F.when(entity.rlike("[A-F]"), F.upper(hexa)).otherwise(hexa)
        code = F.when(entity.startswith("+"), F.length(F.regexp_extract(F.regexp_replace(entity, "[^0-9]", ""), CODES, 1))).otherwise(0)
        phone = bound(code, lambda n: _dealt(seed, entity, n))
        card = _checked(entity, _dealt(seed, entity, 1))
        out = F.when(kind == "credential", _credential(seed, entity)).when(kind == "email", email).when(kind == "iban", _iban(seed, entity)).when(kind == "secret", secret)
        return out.when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "phone", phone).otherwise(_name(seed, entity, extra))

    seed = F.sha2(F.concat(F.lit(key), F.lit("|"), attempt.cast("string"), F.lit("|"), same), 256)
    return bound(F.struct(kind.alias("kind"), entity.alias("entity"), seed.alias("seed"), attempt.alias("attempt")), made)


def collisions(found: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(same, attempt) of canonical forms that need an attempt above 0; found: (kind, entity, same), one row for each different entity.

    Each round deals surrogates to those that collided, and raises the attempt of a form whose surrogate another, smaller, form has too, or which is itself an
    entity of the corpus. Surrogates are compared in canonical form, which is one for all spellings of an entity. Where a kind's surrogates run out, so that
    some still collide after all rounds, an error is raised.
    """
    kind, entity, same, attempt = (F.col(c) for c in ("kind", "entity", "same", "attempt"))
    out = bound(surrogate(kind, entity, same, attempt, key), lambda new: canonical(kind, new)).alias("out")
    forms = found.groupBy("same").agg(F.first("kind").alias("kind"), F.min("entity").alias("entity")).withColumn("attempt", F.lit(0))
    forms = cut(forms.select("same", "kind", "entity", "attempt", out))
    for _ in range(rounds):
        held = forms.groupBy("out").agg(F.min("same").alias("owner"), F.count("*").alias("n")).where("n > 1").select("out", "owner")
        real = forms.select(F.col("same").alias("out")).join(forms.select("out"), "out", "left_semi").select("out", F.lit(None).cast("string").alias("owner"))
        bad = forms.join(held.unionByName(real), "out").where("owner is null or owner <> same").select("same").distinct()
        bad = cut(bad)
        if bad.isEmpty():
            return forms.where("attempt > 0").select("same", "attempt")
        again = forms.join(bad, "same").withColumn("attempt", attempt + 1).select("same", "kind", "entity", "attempt", out)
        forms = cut(forms.join(bad, "same", "left_anti").unionByName(again))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds: a kind has more entities than surrogates")


def replace(docs: DataFrame, text: str = "text", key: str = "gatewarden", small_rows: int = 1_000) -> DataFrame:
    """docs with entities replaced in text, and n_entities, entities: array of (kind, surrogate) in order of place. Columns of these names are replaced.

    Collided forms are few as a rule. Where they are small_rows at most they travel as one map; where there are more, they are joined to
    the entities of the documents that hold them.
    """
    docs = docs.drop("n_entities", "entities")
    some = F.col(text).rlike(ANY)
    each = docs.where(some).select(F.explode(F.array_distinct(entities_of(F.col(text)))).alias("entity")).distinct()
    each = each.withColumn("kind", kind_of(F.col("entity"))).withColumn("same", canonical(F.col("kind"), F.col("entity")))
    again = collisions(each.select("kind", "entity", "same"), key).persist()
    n = again.count()
    with_own = docs.withColumn("__e", F.when(some, entities_of(F.col(text))))
    if not n:
        with_own = with_own.withColumn("__a", F.lit(None).cast("map<string,int>"))
    elif n <= small_rows:
        pairs = {r[0]: r[1] for r in again.collect()}
        with_own = with_own.withColumn("__a", F.create_map(*[F.lit(x) for p in pairs.items() for x in p]))
    else:
        held = docs.where(some).select(F.xxhash64(text).alias("__t"), F.explode(F.array_distinct(entities_of(F.col(text)))).alias("entity")).distinct()
        held = held.withColumn("same", canonical(kind_of(F.col("entity")), F.col("entity"))).join(again, "same")
        maps = held.groupBy("__t").agg(F.map_from_entries(F.collect_set(F.struct("same", "attempt"))).alias("__a"))
        with_own = with_own.withColumn("__t", F.xxhash64(text)).join(maps, "__t", "left").drop("__t")

    def one(e: Column) -> Column:
        new = lambda k: surrogate(k["kind"], e, k["same"], F.coalesce(F.col("__a")[k["same"]], F.lit(0)), key)
        form = lambda kind: bound(F.struct(kind.alias("kind"), canonical(kind, e).alias("same")), lambda k: F.struct(k["kind"].alias("kind"), new(k).alias("new")))
        return bound(kind_of(e), form)

    bare = F.transform(F.filter("__e", lambda e: e.rlike(f"^{TITLE}") & F.regexp_replace(e, f"^{TITLE}", "").contains(" ")), lambda e: F.regexp_replace(e, f"^{TITLE}", ""))
    around = F.when(F.size(bare) == 0, F.split(F.col(text), ANY, -1)).otherwise(F.split(F.col(text), with_names(bare), -1))
    out = with_own.withColumns({"__s": F.transform("__e", one), "__g": F.when(F.col("__e").isNotNull(), around)})
    joined = F.array_join(F.zip_with("__g", "__s", lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s["new"], F.lit("")))), "")
    return out.withColumns(
        {
            text: F.when(F.col("__e").isNull(), F.col(text)).otherwise(joined),
            "n_entities": F.coalesce(F.size("__s"), F.lit(0)).cast("long"),
            "entities": F.coalesce(F.col("__s"), F.array().cast("array<struct<kind:string,new:string>>")),
        }
    ).drop("__e", "__a", "__s", "__g")


def op10(spark, sf_dir: str) -> DataFrame:
    """Each row of documents with surrogates in its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs).select("doc_id", "n_entities", F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))).alias("kinds"), "text")
