"""Variant spellings of names typed by people: canonical rewritings, exploded and joined on equality.

A name is folded (look-alikes, case, accents, spacing), freed of titles and honours and split into full words, initials
and a generation suffix.  Rules rewrite it:

* token order: of two full words the one that more often stands in the given name's place, over all names, is the given
  name; ``Last, First``, ``Last| First`` and ``Last First`` become the same;
* nicknames: a short form stands for each of the names it is short for.  The fixed table is joined by the rules that the
  earlier search's groups show (two given names before one surname, seen repeatedly);
* misspelling: every word is exploded into its forms with one letter left out, so that words one edit apart meet, once for
  all words of all names;
* initials: a given name stands for its initial, middle initials may be left out;
* legal forms: what says that a name is a company's (Ltd, GmbH, S.A., ...) is left out, as are small words; the other words
  of an organisation are whole words, in any order.  Usual abbreviations are written out by table, others (a word with a
  full stop) stand for words that begin so.

Rewritten forms are joined on equality, never compared all against all.  Each form's rarity is the number of different
persons or organisations that it can stand for, and a link's score is 1 divided by it: a form that stands for exactly one
links, one that stands for several doesn't.  Linked spellings are consolidated into groups; ``name_groups`` gives every id
its group and the score of the form that put it there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookwarp.llm.components import connected_groups
from bookwarp.llm.lookalike import table_form
from bookwarp.stage import blank, cut

# Fixed values.
TITLES = frozenset("dr prof professor rev reverend sir dame lady lord mr mrs ms miss mx hon phd md dphil msc ma ba mba esq ed eds editor trans translator".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "2", "iii": "3", "iv": "4"}
SMALL = frozenset("of for the and in at on a an de la der die das und et du des y e und".split())
#: Legal forms of companies, in several languages.
LEGAL = frozenset("ltd limited inc incorporated corp llc llp plc pty pte gmbh ggmbh kgaa ohg sarl sasu eurl srl ltda eireli oyj kft zrt nyrt sro".split())
#: Short ones, which may be initials or names as well: left out where other words show an organisation.
SHORT_LEGAL = frozenset("co cie lp ag kg gbr ug ev eg se sa sas snc scs spa sapa sl slu sau lda bv nv vof cv as asa ab hb oy aps ks hf ehf zoo doo dd ood ad kk".split())
#: Legal forms of several words.
LEGAL_PHRASES = (
    ("gesellschaft", "mit", "beschrankter", "haftung"), ("societe", "anonyme"), ("sociedad", "anonima"), ("sociedad", "limitada"), ("societa", "per", "azioni"),
    ("eingetragener", "verein"), ("sp", "zoo"), ("spol", "sro"), ("public", "limited", "company"), ("limited", "liability", "company"), ("limited", "company"),
)
#: Words that only organisations have in their names.
ORGANISED = frozenset("""
university universitat universite universidad universita college academy academie akademie school institute institut institution faculty department laboratory laboratories
society association federation foundation stiftung trust union league council committee commission board ministry agency office bureau authority
press publishing publishers publications verlag editions editorial books company group studio studios
center centre library museum gallery club consortium corporation
""".split())
#: Usual abbreviations of such words.
WRITTEN_OUT = {
    "univ": "university", "coll": "college", "acad": "academy", "inst": "institute", "dept": "department", "dep": "department", "lab": "laboratory", "soc": "society", "assoc": "association", "assn": "association",
    "fed": "federation", "found": "foundation", "fdn": "foundation", "comm": "committee", "min": "ministry", "publ": "publishing", "pub": "publishing", "ed": "editions", "ctr": "center", "centre": "center", "lib": "library", "mus": "museum", "intl": "international", "natl": "national",
}
#: Of these only the ones that can't be a person's word make an organisation.
CERTAIN = ORGANISED - {"books", "school", "college", "group", "trust", "board", "club", "union", "press"} | {"univ", "dept", "assoc", "assn", "inst", "soc", "acad"}
GENERIC = ORGANISED | {"univ", "coll", "acad", "inst", "dept", "soc", "assoc", "assn", "fdn"}
NICKNAMES = """
abe abraham; aggie agnes; al albert; alex alexander; andy andrew; annie anne; art arthur; babs barbara; barb barbara; bea beatrice; becca rebecca; becky rebecca; ben benjamin;
bernie bernard; bert albert; bess elizabeth; beth elizabeth; betty elizabeth; bill william; billy william; bob robert; bobby robert; bridie bridget; biddy bridget; carrie caroline; caro caroline;
cathy katherine; charlie charles; chuck charles; chris christine; tina christine; chrissie christine; dan daniel; danny daniel; dave david; deb deborah; debbie deborah; den dennis; denny dennis; di diana;
dick richard; dolly dorothy; dot dorothy; drew andrew; ed edward; eddie edward; ted edward; ned edward; ellie eleanor; nell eleanor; nellie eleanor; lena magdalena; maggie margaret; meg margaret; peggy margaret;
ernie ernest; essie esther; flo florence; flossie florence; fran frances; frank francis; fred frederick; freddie frederick; gabe gabriel; gerry gerald; jerry gerald; greg gregory; hal harold; harry harold;
hank henry; ike isaac; izzy isaac; jack john; johnny john; jake jacob; jim james; jimmy james; jamie james; joe joseph; joey joseph; jo joanna; julie julia; kate katherine; katie katherine; kathy katherine; kit katherine;
ken kenneth; kenny kenneth; larry lawrence; laurie laura; len leonard; lenny leonard; liz elizabeth; lizzie elizabeth; lou louise; luke lucas; maddy magdalena; marty martin; mattie matilda; tilly matilda; tilda matilda;
mike michael; mick michael; mim miriam; nat nathaniel; nate nathaniel; nick nicholas; ollie oliver; paddy patrick; pat patrick; pat patricia; patty patricia; trish patricia; pete peter; phil philip; rae rachel; ray raymond;
rick richard; rich richard; rob robert; robbie robert; ros rosalind; roz rosalind; rosie rosalind; sal sarah; sally sarah; sadie sarah; sam samuel; sammy samuel; seb sebastian; si simon; sophie sophia; steve stephen;
sue susan; susie susan; suzy susan; tad thaddeus; thad thaddeus; terry theresa; tess theresa; tessa theresa; tim timothy; timmy timothy; tom thomas; tommy thomas; tony anton; val valentin; vic victor; vicky victoria;
vicki victoria; wally walter; walt walter; wilf wilfred; will william; zach zachary; zack zachary;
benj benjamin; chas charles; danl daniel; edw edward; eliz elizabeth; fredk frederick; geo george; jas james; jno john; jos joseph; margt margaret; nathl nathaniel; richd richard; robt robert; saml samuel;
theo theodore; thos thomas; wm william; gerd gerard; alexr alexander; andw andrew; cath catherine; patk patrick; michl michael; natl nathaniel; laur laurence; sus susan; seb sebastian; tim timothy
"""
WORD = re.compile(r"[^\W\d_]+")
STOPPED = re.compile(r"[^\W_]+\.?")
DOTTED = re.compile(r"(?<!\w)(?:[^\W\d_]\.){2,}")


def nickname_rules() -> list[tuple[str, str]]:
    return [tuple(p.split()) for p in NICKNAMES.replace("\n", " ").split(";")]


SPACES = re.compile(r"[\s⠀]+")
_look = lru_cache(65536)(table_form)


def folded_name(name: str) -> str:
    """Lower case without accents, look-alikes and invisible signs."""
    if name.isascii() and name.isprintable():
        return " ".join(name.lower().split())
    text = " ".join([x for w in SPACES.split(name) if (x := _look(w))]).lower()
    if text.isascii():
        return text
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("ł", "l").replace("ø", "o").replace("ß", "ss").replace("đ", "d")


def organisation(text: str) -> list[str] | None:
    """The words of a folded name if it is an organisation's, sorted, else nothing.

    Legal forms are left out where they stand last before a separator; abbreviations that the table doesn't know keep their
    full stop.
    """
    text = DOTTED.sub(lambda m: m[0].replace(".", "") if m[0].replace(".", "") in LEGAL | SHORT_LEGAL else m[0], re.sub(r"['’`]", "", text))
    parts = [STOPPED.findall(p) for p in re.split(r"[,;()|/]", text)]
    known = {w.rstrip(".") for p in parts for w in p}
    many = len(known & ORGANISED)
    certain = bool(known & CERTAIN) or many > 1 or (many == 1 and bool(known & SMALL)) or "&" in text
    legal = False
    for words in parts:
        while words:
            bare = [w.rstrip(".") for w in words]
            phrase = next((p for p in LEGAL_PHRASES if tuple(bare[-len(p) :]) == p), None)
            whole = len(bare) > 1 or len(parts) > 1
            if phrase is None and not (whole and (bare[-1] in LEGAL or (certain and bare[-1] in SHORT_LEGAL))):
                break
            legal = True
            del words[-len(phrase or (1,)) :]
    words = [w for p in parts for w in p]
    if not words or not (legal or (certain and known & GENERIC)):
        return None
    bare = [w.rstrip(".") for w in words]
    return sorted({WRITTEN_OUT.get(b, w if len(b) > 2 else b) for w, b in zip(words, bare, strict=True) if b not in SMALL}, key=lambda w: (w[:3], w)) or None


def parse(name: str) -> tuple[str, list[str], list[str], str, bool]:
    """(kind, full words in given-name-first order, initials, suffix, whether the order is stated)."""
    text = folded_name(name)
    if (org := organisation(text)) is not None:
        return "org", org, [], "", False
    # what stands before the first separator is the surname, if words follow it
    before, sep, after = re.sub(r"\([^()]*\)", " ", text).partition(next((c for c in text if c in ",|"), "\0"))
    plain = [w for w in WORD.findall(text) if w not in TITLES]
    suffix = "".join(sorted({SUFFIXES[w] for w in plain if w in SUFFIXES}))
    head, tail = ([w for w in WORD.findall(p) if w not in TITLES and w not in SUFFIXES] for p in (before, after))
    stated = bool(sep) and bool(head) and bool(tail)
    words = tail + head if stated else head + tail
    if any(len(w) > 1 for w in words):
        return "person", [w for w in words if len(w) > 1], [w for w in words if len(w) == 1], suffix, stated
    return ("none", [], [], "", False) if not words else ("person", words, [], suffix, stated)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [parse(n) for n in batch["name"]]
        yield pd.DataFrame({"name": batch["name"], "kind": [r[0] for r in rows], "full": [r[1] for r in rows], "initials": [r[2] for r in rows], "suffix": [r[3] for r in rows], "stated": [r[4] for r in rows]})


def one_edit(a: str, b: str) -> bool:
    """Equal, or one letter replaced, left out, added or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


@F.pandas_udf(T.BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _left_out(word: str) -> F.Column:
    """A word and its forms with one letter left out."""
    return F.expr(f"array_distinct(concat(array({word}), transform(sequence(1, length({word})), i -> concat(substring({word}, 1, i - 1), substring({word}, i + 1)))))")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n, m), both ways: different words (word, n) one edit apart, n and m their counts.

    Forms with a letter left out keep the letter and its place, which tell whether two words that share a form are one
    edit apart: the same place, a whole word, or neighbouring places with the same letter.
    """
    left = "transform(sequence(1, length(word)), i -> named_struct('f', xxhash64(concat(substring(word, 1, i - 1), substring(word, i + 1))), 'at', i, 'c', substring(word, i, 1)))"
    whole = "array(named_struct('f', xxhash64(word), 'at', 0, 'c', ''))"
    forms = words.select("word", "n", F.explode(F.expr(f"concat({whole}, {left})")).alias("_f")).select("word", "n", "_f.f", "_f.at", "_f.c")
    b = forms.toDF("other", "m", "f", "_at", "_c")
    close = (F.col("at") == F.col("_at")) | (F.col("at") == 0) | (F.col("_at") == 0) | ((F.abs(F.col("at") - F.col("_at")) == 1) & (F.col("c") == F.col("_c")))
    met = forms.join(b, "f").filter((F.col("word") != F.col("other")) & close & (F.levenshtein("word", "other") <= 2))
    return met.select("word", "other", "n", "m").distinct()


KNOWN_GIVEN = 5
#: How many times more frequent a given name is than a misspelling of it.
FAR_MORE = 15
#: How far a misspelt given name counts as one.
MISSPELT = 0.9


def parsed_names(authors: DataFrame, key: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """((id, name), parsed distinct names); null ids and null or blank names are left out."""
    ids = authors.filter(F.col(key).isNotNull() & ~blank(F.col(name))).select(F.col(key).alias("id"), F.col(name).alias("name")).distinct()
    return ids, cut(ids.select("name").distinct().mapInPandas(_parsed, "name string, kind string, full array<string>, initials array<string>, suffix string, stated boolean"))


def spellings(ids: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, kind, given, middle, surname, suffix, rest), words one edit apart): the parts of each name.

    Of one-word names only the surname; of organisations all words, sorted, as the rest.  Given names that are unknown and
    one edit from a known one are read as that one.
    """
    people = parsed.filter("kind = 'person'")
    counted = people.select((F.size("full") == 2).alias("two"), F.posexplode("full").alias("at", "word"))
    # how often each full word stands first (after stated orders are applied) among names of two full words
    placed = counted.groupBy("word").agg(F.count("*").alias("all"), F.count_if("two").alias("n"), F.count_if(F.col("two") & (F.col("at") == 0)).alias("f"))
    placed = cut(placed.withColumn("given", F.when(F.col("n") > 0, (F.col("f") + 0.5) / (F.col("n") + 1))))
    near = cut(near_words(placed.filter("length(word) >= 3").select("word", F.col("all").alias("n"))))
    known = placed.filter(f"n >= {KNOWN_GIVEN} and given >= 0.6").select("word", "n")
    # words one edit from a known given name that is far more frequent are misspellings of it, unless they are short forms
    shorts = ids.sparkSession.createDataFrame(nickname_rules(), "word string, given string").select("word")
    rare = placed.filter("n > 0").select("word", F.col("n").alias("own")).join(shorts, "word", "left_anti")
    right = near.select("word", F.col("other").alias("to")).join(known.select(F.col("word").alias("to"), "n"), "to").join(rare, "word")
    right = right.filter((F.col("n") >= FAR_MORE * F.col("own")) | (F.col("own") == 1))
    right = right.groupBy("word").agg(F.max(F.struct("n", "to")).alias("_m")).select("word", F.col("_m.to").alias("to"))
    score = cut(placed.filter("n > 0").join(right, "word", "left").select("word", F.when(F.col("to").isNotNull(), F.greatest("given", F.lit(MISSPELT))).otherwise(F.col("given")).alias("given"), F.coalesce("to", "word").alias("to")))
    two = people.filter("size(full) >= 2").select("name", "initials", "suffix", F.col("full")[0].alias("x"), F.element_at("full", -1).alias("y"), F.slice("full", 2, F.size("full") - 2).alias("inner"))
    two = two.join(score.toDF("x", "gx", "tx"), "x", "left").join(score.toDF("y", "gy", "ty"), "y", "left")
    turned = F.coalesce("gy", F.lit(0.4)) > F.coalesce("gx", F.lit(0.6))
    given, surname = F.when(turned, F.coalesce("ty", "y")).otherwise(F.coalesce("tx", "x")), F.when(turned, F.col("x")).otherwise(F.col("y"))
    mids = F.concat("initials", F.transform("inner", lambda w: F.substring(w, 1, 1)))
    full = two.select("name", F.lit("person").alias("kind"), given.alias("given"), F.array_join(F.array_sort(mids), "").alias("middle"), surname.alias("surname"), "suffix", F.lit("").alias("rest"))
    # one full word: its initials are those of the given and middle names
    short = people.filter("size(full) = 1").select("name", F.lit("person"), F.lit(""), F.array_join("initials", ""), F.col("full")[0], "suffix", F.lit(""))
    orgs = parsed.filter("kind = 'org'").select("name", F.lit("org"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.array_join("full", " "))
    return ids.join(full.union(short).union(orgs), "name").select("id", "kind", "given", "middle", "surname", "suffix", "rest"), near


def learned_nicknames(groups: DataFrame, parts: DataFrame, least: int = 2) -> DataFrame:
    """(short, given): given names that stand before one surname in at least so many of the known groups."""
    members = groups.select("group_id", F.explode(F.concat(F.array("canonical_author_id"), F.coalesce("duplicate_author_ids", F.array().cast("array<bigint>")))).alias("id"))
    held = members.join(parts.filter("kind = 'person' and length(given) > 1").select("id", "given", "surname"), "id").select("group_id", "given", "surname").distinct()
    met = held.join(held.withColumnRenamed("given", "other"), ["group_id", "surname"]).filter("given < other and levenshtein(given, other) > 1")
    counted = met.groupBy("given", "other").agg(F.count_distinct("group_id").alias("n")).filter(F.col("n") >= least)
    return counted.select(F.col("given").alias("short"), F.col("other").alias("given"))


def person_links(people: DataFrame, nicknames: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links (a, b) of spelling ids, forms of full names, names with initials only); one row of ``people`` per spelling."""
    full = people.filter("given <> ''").select("sid", "given", "middle", "surname", "suffix")
    forms = full.join(nicknames.select(F.col("short").alias("given"), F.col("given").alias("as")), "given", "left")
    forms = cut(forms.select("sid", F.explode(F.array_distinct(F.array_compact(F.array("given", "as")))).alias("given"), F.col("given").alias("own"), "middle", "surname", "suffix"))
    # a person, as far as the full words tell: given name, surname, suffix; spellings with other middle initials differ
    key = ["given", "surname", "suffix"]
    told = F.when(F.col("middle") != "", F.col("middle"))
    persons = cut(forms.groupBy(*key).agg(F.min("sid").alias("head"), F.min(told).alias("one"), F.max(told).alias("other"), F.max("middle").alias("middle")))
    heads = forms.join(persons.select(*key, "head", (F.coalesce("one", F.lit("")) == F.coalesce("other", F.lit(""))).alias("single")), key)
    same = heads.filter("single and sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    several = heads.filter("not single and middle <> ''").select("sid", *key, "middle")
    firsts = several.groupBy(*key, "middle").agg(F.min("sid").alias("first"))
    several = several.join(firsts, [*key, "middle"]).filter("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    # surnames one edit apart, with the same given name and suffix and no two different middle initials
    long = near.filter("word < other and length(word) >= 5 and length(other) >= 5").select(F.col("word").alias("surname"), "other")
    x = persons.select(*key, "head", "middle").join(long, "surname").select("given", "suffix", F.col("other").alias("surname"), F.col("head").alias("sa"), F.col("middle").alias("ma"))
    met = x.join(persons.select(*key, F.col("head").alias("sb"), F.col("middle").alias("mb")), key).filter("ma = '' or mb = '' or ma = mb").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    # initials: the first one is the given name's; it links if exactly one person of that surname has it
    initial = people.filter("given = '' and middle <> ''").select("sid", F.substring("middle", 1, 1).alias("i"), F.expr("substring(middle, 2)").alias("m"), "surname", "suffix")
    return same.unionByName(several).unionByName(met), forms, initial


def org_links(orgs: DataFrame) -> DataFrame:
    """(a, b): links of organisations' spellings (sid, rest): one word misspelt, or abbreviated words that stand for one organisation's."""
    words = F.split("rest", " ")
    named = orgs.groupBy("rest").agg(F.min("sid").alias("sid")).withColumn("ws", words)
    alike = orgs.join(named.select("rest", F.col("sid").alias("b")), "rest").filter("sid <> b").select(F.col("sid").alias("a"), "b")
    whole = named.filter(~F.col("rest").contains("."))
    # the other words are the same, the one left out is one edit away
    each = whole.filter("size(ws) > 1").select("sid", F.posexplode("ws").alias("i", "word"), "ws").filter("length(word) > 3")
    each = each.select("sid", "word", F.xxhash64(F.array_join(F.filter("ws", lambda w: w != F.col("word")), " ")).alias("others"))
    forms = each.select("sid", "word", "others", F.explode(_left_out("word")).alias("_f")).select("sid", "word", F.xxhash64("others", "_f").alias("_f"))
    met = forms.toDF("a", "wa", "_f").join(forms.toDF("b", "wb", "_f"), "_f").filter("a < b").distinct().filter(_one_edit("wa", "wb")).select("a", "b")
    # abbreviated words: beginnings of three letters meet, then every word must be the one meant
    stems = F.xxhash64(F.array_join(F.transform("ws", lambda w: F.substring(w, 1, 3)), " "))
    short = named.filter(F.col("rest").contains(".")).select(F.col("sid").alias("a"), F.col("ws").alias("xs"), stems.alias("stems"))
    fits = F.forall(F.zip_with("xs", "ys", lambda x, y: (x == y) | (x.endswith(".") & y.startswith(F.rtrim(x, F.lit("."))))), lambda ok: ok)
    met_short = short.join(whole.select(F.col("sid").alias("b"), F.col("ws").alias("ys"), stems.alias("stems")), "stems").filter((F.size("xs") == F.size("ys")) & fits)
    rare = met_short.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).filter("n = 1").select("a", "b")
    return alike.unionByName(met).unionByName(rare)


def _standing(forms: DataFrame, labels: DataFrame, initial: DataFrame, near: DataFrame) -> DataFrame:
    """(sid, n, person): for each name of initials the number of persons that it can stand for, and the first of them."""
    who = forms.join(labels, "sid").select("person", F.substring("own", 1, 1).alias("i"), F.substring("given", 1, 1).alias("j"), "middle", "surname", "suffix")
    stands = who.select("person", F.explode(F.array_distinct(F.array("i", "j"))).alias("i"), "middle", "surname", "suffix").distinct()
    fits = "m = '' or middle = '' or m = middle"
    exact = initial.join(stands, ["i", "surname", "suffix"]).filter(fits)
    # misspelt surnames: one edit, where the exact surname stands for nobody
    lone = initial.join(exact.select("sid").distinct(), "sid", "left_anti").filter("length(surname) >= 5")
    close = lone.join(near.filter("length(other) >= 5").select(F.col("word").alias("surname"), "other"), "surname").drop("surname").withColumnRenamed("other", "surname")
    close = close.join(stands, ["i", "surname", "suffix"]).filter(fits)
    found = exact.select("sid", "person").unionByName(close.select("sid", "person")).distinct()
    return found.groupBy("sid").agg(F.count("*").alias("n"), F.min("person").alias("person"))


def name_groups(authors: DataFrame, groups: DataFrame | None = None, key: str = "id", name: str = "name") -> DataFrame:
    """(id, person, score): the group of each id's name, named by one of its spellings, and 1 / the number of groups that the
    form which put it there can stand for.

    Null ids and null or blank names are in no group; names without a word neither.  An id sent with several names is in all
    their groups.  A name that may be several persons' has a group of its own with the like names, and a score below 1.
    Suffixes such as Jr. and Sr. tell persons apart.  Empty tables give no rows.
    """
    spark = authors.sparkSession
    ids, parsed = parsed_names(authors, key, name)
    parts, near = spellings(ids, parsed)
    parts = cut(parts)
    rules = spark.createDataFrame(nickname_rules(), "short string, given string")
    if groups is not None:
        rules = rules.unionByName(learned_nicknames(groups, parts)).distinct()
    spelled = ["kind", "given", "middle", "surname", "suffix", "rest"]
    sid = F.xxhash64(*spelled)
    numbered = cut(parts.select(sid.alias("sid"), *spelled).distinct())
    links, forms, initial = person_links(numbered.filter("kind = 'person'"), rules, near)
    links = links.unionByName(org_links(numbered.filter("kind = 'org'").select("sid", "rest")))
    linked = connected_groups(links.select(F.lit("n").alias("kind"), "a", "b"), "kind", "a", "b").select(F.col("record_id").alias("sid"), F.col("group_id").alias("person"))
    labels = numbered.filter("kind = 'org' or given <> ''").select("sid").join(linked, "sid", "left").select("sid", F.coalesce("person", "sid").alias("person"))
    labels = cut(labels)
    standing = cut(_standing(forms, labels, initial, near))
    more = standing.filter("n = 1").select("sid", "person", F.lit(1.0).alias("score"))
    # initials that no person was found for, or several, still belong to their like
    like = initial.groupBy("i", "m", "surname", "suffix").agg(F.min("sid").alias("person"))
    lone = initial.join(more.select("sid"), "sid", "left_anti").join(like, ["i", "m", "surname", "suffix"]).join(standing.select("sid", "n"), "sid", "left")
    lone = lone.select("sid", "person", (1 / F.coalesce("n", F.lit(1))).alias("score"))
    only = numbered.filter("kind = 'person' and given = '' and middle = ''").select("sid", F.col("sid").alias("person"), F.lit(1.0).alias("score"))
    final = labels.withColumn("score", F.lit(1.0)).unionByName(more).unionByName(lone).unionByName(only)
    return parts.select("id", sid.alias("sid")).join(final, "sid").groupBy("id", "person").agg(F.max("score").alias("score"))


def linked_authors(authors: DataFrame, groups: DataFrame | None = None, key: str = "id", name: str = "name") -> DataFrame:
    """(author_a, author_b), author_a < author_b: every two ids of one person or organisation, from ``name_groups``."""
    members = cut(name_groups(authors, groups, key, name).select("id", "person"))
    met = members.select(F.col("id").alias("author_a"), "person").join(members.select(F.col("id").alias("author_b"), "person"), "person").filter("author_a < author_b")
    return met.select("author_a", "author_b").distinct()
