"""From model answers and parsed tokens to entities and triples."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.config import DEFAULT_RELATION
from twinweave.functions.text import extract_json, strip, strip_lower

EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, triples array<struct<subject:string,relation:string,object:string,evidence:string,confidence:string>>"
RECONCILIATION = "canonical_entities array<struct<canonical:string,aliases:array<string>>>"
#: Dependency labels that stand for subjects and objects.
SUBJECTS = ("nsubj", "nsubjpass")
OBJECTS = ("dobj", "obj", "pobj", "attr", "dative", "oprd")
COMPLEMENTS = ("attr", "acomp", "oprd")


def ask(chunks: DataFrame, client: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """chunks with ``answer`` from a pluggable model client, called in the tasks.

    A ValueError from the client is a malformed answer and asked again with a
    reminder, up to ``attempts`` times; then the answer is null.
    """

    def run(batches):
        for batch in batches:
            answers = []
            for text in batch.column(batch.schema.get_field_index("prompt")).to_pylist():
                answer = None
                for n in range(attempts):
                    try:
                        answer = client(text + "\nReturn only valid JSON." * n)
                        break
                    except ValueError:
                        continue
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, "answer"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{fields}, answer string")


def parsed(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """answers with ``block``; rows without valid JSON go."""
    return answers.withColumn("block", F.from_json(extract_json(F.col(text_col)), EXTRACTION)).where("block is not null and (block.entities is not null or block.triples is not null)")


def parse_entities(answers: DataFrame, id_col: str, text_col: str = "answer", cap: int = 25) -> DataFrame:
    """id, pos, name, type, description of the first ``cap`` entities; names stripped, blank ones dropped."""
    rows = parsed(answers, text_col).select(id_col, F.posexplode(F.slice("block.entities", 1, cap)).alias("pos", "e"))
    kind = strip(F.coalesce("e.type", F.lit("")))
    return rows.select(id_col, "pos", strip(F.coalesce("e.name", F.lit(""))).alias("name"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("Other")).alias("type"), strip(F.coalesce("e.description", F.lit(""))).alias("description")).where("name <> ''")


def parse_triples(answers: DataFrame, id_col: str, text_col: str = "answer", cap: int = 20) -> DataFrame:
    """id, pos, subject, relation, object, evidence, confidence of the first ``cap`` triples."""
    rows = parsed(answers, text_col).select(id_col, F.posexplode(F.slice("block.triples", 1, cap)).alias("pos", "t"))
    part = lambda n: strip(F.coalesce(f"t.{n}", F.lit("")))
    return rows.select(id_col, "pos", part("subject").alias("subject"), F.coalesce(F.nullif(part("relation"), F.lit("")), F.lit(DEFAULT_RELATION)).alias("relation"), part("object").alias("object"), F.col("t.evidence").alias("evidence"), F.col("t.confidence").try_cast("double").alias("confidence"))


def parse_reconciliation(answers: DataFrame, id_col: str, text_col: str = "answer") -> DataFrame:
    """pos, canonical, aliases of all mappings, none for broken answers."""
    block = F.from_json(extract_json(F.col(text_col)), RECONCILIATION)
    rows = answers.select(id_col, F.posexplode(block["canonical_entities"]).alias("k", "m"))
    return rows.select(F.struct(id_col, "k").alias("pos"), strip(F.coalesce("m.canonical", F.lit(""))).alias("canonical"), F.coalesce("m.aliases", F.array().cast("array<string>")).alias("aliases")).where("canonical <> ''")


def sanitize_triples(triples: DataFrame) -> DataFrame:
    """Triples whose subject and object aren't blank, their parts stripped."""
    out = triples.withColumns({"subject": strip(F.coalesce("subject", F.lit(""))), "object": strip(F.coalesce("object", F.lit("")))})
    return out.where("subject <> '' and object <> ''")


def canonicalize(triples: DataFrame, lookup: DataFrame) -> DataFrame:
    """Triples with subject and object replaced by lookup(key, canonical), else stripped; blank ones go.

    The lookup grows with the vocabulary, so it is joined, not broadcast by hint.
    """
    s = lookup.select(F.col("key").alias("sk"), F.col("canonical").alias("sc"))
    o = lookup.select(F.col("key").alias("ok"), F.col("canonical").alias("oc"))
    keyed = triples.withColumns({"sk": strip_lower(F.col("subject")), "ok": strip_lower(F.col("object"))})
    named = keyed.join(s, "sk", "left").join(o, "ok", "left").withColumns({"subject": F.coalesce("sc", strip(F.col("subject"))), "object": F.coalesce("oc", strip(F.col("object")))})
    return named.drop("sk", "ok", "sc", "oc").where("subject <> '' and object <> ''")


def entity_dedup(names: DataFrame) -> DataFrame:
    """key, name of names(name, pos): the first spelling of each name, case aside."""
    clean = names.select(strip(F.col("name")).alias("name"), "pos").where("name <> ''")
    return clean.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("pos", "name")).alias("name"))


def entity_merge(entities: DataFrame) -> DataFrame:
    """key, name, type, description, pos of entities(name, type, description, pos).

    The last name, the first type, the first description that isn't empty, and the
    first position of each name, case aside.
    """
    described = F.when(F.col("description") != "", F.col("pos"))
    return entities.groupBy(F.lower("name").alias("key")).agg(
        F.max_by("name", "pos").alias("name"), F.min_by("type", "pos").alias("type"),
        F.coalesce(F.min_by("description", described), F.lit("")).alias("description"), F.min("pos").alias("pos"),
    )


def entity_list(entities: DataFrame) -> DataFrame:
    """name, type, description of the first spelling of each name(name, type, description, pos), case aside; blank names go."""
    clean = entities.withColumn("name", strip(F.col("name"))).where("name <> ''")
    first = F.min_by(F.struct("name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description")), F.struct("pos", "name"))
    return clean.groupBy(F.lower("name").alias("key")).agg(first.alias("e")).select("e.*")


def write_entities(entities: DataFrame, folder: str) -> None:
    """entities(name, type, description, pos) as a list of names and as JSON records, sorted by lower name: one file each."""
    listed = entity_list(entities).orderBy(F.lower("name"), "name").coalesce(1)
    listed.select("name").write.mode("overwrite").text(f"{folder}/entities")
    listed.write.mode("overwrite").json(f"{folder}/entities_metadata")


def token_entities(tokens: DataFrame, ents: DataFrame) -> DataFrame:
    """doc, i, ent_id: a token's entity, else the entities of its compound children.

    tokens(doc, i, head, pos, dep, lemma, text); ents(doc, ent_id, start, end, text).
    """
    e = ents.select("doc", "ent_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    own = tokens.select("doc", "i").join(e, ["doc", "i"])
    children = tokens.where("dep = 'compound'").select("doc", "i", F.col("head").alias("up")).join(e, ["doc", "i"]).select("doc", F.col("up").alias("i"), "ent_id")
    return own.unionByName(children.join(own.select("doc", "i"), ["doc", "i"], "left_anti")).distinct()


def relation_label(tokens: DataFrame) -> DataFrame:
    """doc, i, label of verbs: lemma (be: is), sorted particles, sorted prepositions with their first object."""
    child = tokens.select("doc", F.col("head").alias("h"), F.col("i").alias("c"), F.col("dep").alias("cd"), F.lower("lemma").alias("cl"))
    verbs = tokens.where("pos in ('VERB', 'AUX')").select("doc", "i", F.when(F.lower("lemma") == "be", "is").otherwise(F.lower("lemma")).alias("lemma"))
    prt = child.where("cd = 'prt'").groupBy("doc", "h").agg(F.array_sort(F.collect_set("cl")).alias("prt"))
    obj = child.where("cd = 'pobj'").groupBy("doc", F.col("h").alias("c")).agg(F.min_by("cl", "c").alias("po"))
    prep = child.where("cd = 'prep'").join(obj, ["doc", "c"], "left").groupBy("doc", "h").agg(F.array_sort(F.collect_set(F.concat_ws("_", "cl", "po"))).alias("prep"))
    empty = F.array().cast("array<string>")
    return (
        verbs.join(prt.withColumnRenamed("h", "i"), ["doc", "i"], "left").join(prep.withColumnRenamed("h", "i"), ["doc", "i"], "left")
        .select("doc", "i", F.coalesce(F.nullif(F.array_join(F.concat(F.array("lemma"), F.coalesce("prt", empty), F.coalesce("prep", empty)), "_"), F.lit("")), F.lit(DEFAULT_RELATION)).alias("label"))
    )


def dependency_triples(tokens: DataFrame, ents: DataFrame) -> DataFrame:
    """doc, subject, relation, object by the verb, copula, attribute and appositive rules, as a set."""
    at = token_entities(tokens, ents)
    text = ents.select("doc", "ent_id", F.col("text").alias("name"))
    child = tokens.select("doc", F.col("head").alias("h"), F.col("i").alias("c"), F.col("dep").alias("cd")).where("h <> c")
    ent_of = lambda df, token, name: df.join(at.select("doc", F.col("i").alias(token), F.col("ent_id").alias(name)), ["doc", token])
    subjects = child.where(F.col("cd").isin(*SUBJECTS)).select("doc", F.col("h").alias("v"), F.col("c").alias("s"))
    direct = child.where(F.col("cd").isin(*OBJECTS)).select("doc", F.col("h").alias("v"), F.col("c").alias("o"))
    through = child.where("cd = 'prep'").select("doc", F.col("h").alias("v"), F.col("c").alias("m")).join(child.where("cd = 'pobj'").select("doc", F.col("h").alias("m"), F.col("c").alias("o")), ["doc", "m"]).select("doc", "v", "o")
    verbs = tokens.where("pos = 'VERB'").select("doc", F.col("i").alias("v"))
    label = relation_label(tokens).select("doc", F.col("i").alias("v"), F.col("label").alias("relation"))
    objects = ent_of(direct.unionByName(through), "o", "y").select("doc", "v", "y")
    verb = ent_of(subjects.join(verbs, ["doc", "v"]), "s", "x").join(objects, ["doc", "v"]).join(label, ["doc", "v"]).select("doc", "x", "relation", "y")
    is_a = F.lit("is_a").alias("relation")
    cop = child.where("cd = 'cop'").select("doc", F.col("h").alias("v")).distinct()
    extra = child.where(F.col("cd").isin(*COMPLEMENTS)).select("doc", F.col("h").alias("v"), F.col("c").alias("o"))
    complements = cop.select("doc", "v", F.col("v").alias("o")).unionByName(extra.join(cop, ["doc", "v"]).select("doc", "v", "o"))
    copula = ent_of(subjects.join(cop, ["doc", "v"]), "s", "x").join(ent_of(complements, "o", "y").select("doc", "v", "y"), ["doc", "v"]).select("doc", "x", is_a, "y")
    attributes = ent_of(extra, "o", "y").select("doc", "v", "y")
    with_subject = ent_of(subjects, "s", "x").select("doc", "v", "x")
    heads = ent_of(attributes.select("doc", "v").distinct().join(with_subject, ["doc", "v"], "left_anti"), "v", "x").select("doc", "v", "x")
    attribute = attributes.join(with_subject.unionByName(heads), ["doc", "v"]).select("doc", "x", is_a, "y")
    appos = child.where("cd = 'appos'").select("doc", F.col("h").alias("s"), F.col("c").alias("o"))
    own = ent_of(appos, "o", "y").select("doc", "s", "o", "y")
    below = appos.join(own.select("doc", "o"), ["doc", "o"], "left_anti").join(child.where(F.col("cd").isin(*SUBJECTS, *OBJECTS)).select("doc", F.col("h").alias("o"), F.col("c").alias("k")), ["doc", "o"])
    deeper = ent_of(below, "k", "y").select("doc", "s", "o", "y")
    appositive = ent_of(own.unionByName(deeper), "s", "x").select("doc", "x", is_a, "y")
    found = verb.unionByName(copula).unionByName(attribute).unionByName(appositive).where("x <> y")
    named = found.join(text.select("doc", F.col("ent_id").alias("x"), F.col("name").alias("subject")), ["doc", "x"]).join(text.select("doc", F.col("ent_id").alias("y"), F.col("name").alias("object")), ["doc", "y"])
    return named.select("doc", "subject", "relation", "object").distinct()
