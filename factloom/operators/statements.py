"""What a brand's users state about people, laid over what was judged: tags and companies
of contact points, the organisations a person speaks for, and the relations that follow.

Statements come in a stated order (stated_at, correction_id) and can be undone; one that is
undone is as if it had never been made. A stated tag outranks its opposite. What a statement
does depends on those before it, so a person's statements are sorted into one array (people
make them by hand: an array is short) and each point folds over it in one `aggregate`,
inside the JVM. Points and statements meet by person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in the order tags are shown: each tag and the one it contradicts.
TAGS = ("personal_to_user", "personal_not_to_user", "professional_to_brand", "professional_not_to_brand")
OPPOSITE = {
    "personal_to_user": "personal_not_to_user",
    "personal_not_to_user": "personal_to_user",
    "professional_to_brand": "professional_not_to_brand",
    "professional_not_to_brand": "professional_to_brand",
}
PERSONAL = TAGS[:2]
#: From which probability a tag holds, and a domain is an organisation.
TAG_FLOOR, ORGANIZATION_FLOOR = 0.5, 0.5
#: Sources whose presence alone makes a point professional to the brand.
BRAND_TOOLS = ("instantly", "gohighlevel", "posthog", "stripe", "clerk", "copilot", "api", "csv")

COMPANIES = "array<struct<company:string,domain:string,basis:string>>"


def _opposite(tag: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in OPPOSITE.items() for x in kv])
    return pairs[tag]


def in_order(tags: Column) -> Column:
    """The tags of an array, once each, in the order they are shown."""
    return F.array_intersect(F.array(*map(F.lit, TAGS)), tags)


def tags_of_scores(scores: Column) -> Column:
    """Tags of a struct of the four probabilities: all that reach TAG_FLOOR, else the most
    likely one, the first of equals; none where no probability is known."""
    each = F.array(*[F.struct(scores[t].alias("p"), (-F.lit(i)).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TAGS)])
    known = F.filter(each, lambda x: x["p"].isNotNull())
    held = F.transform(F.filter(known, lambda x: x["p"] >= TAG_FLOOR), lambda x: x["t"])
    best = F.array_max(known)["t"]
    return F.when(F.size(held) > 0, held).otherwise(F.filter(F.array(best), lambda t: t.isNotNull()))


def presence_tags(presences: DataFrame, judged: DataFrame) -> DataFrame:
    """(person_id, point, tags) of a person's presences (person_id, point, source, thread,
    posts, group_id, empty_customer): a thread's judged tags; in a group those of the member's
    own posts or else the group's, by which alone nobody is `to user`; and the brand's own
    tools. Unions per point; a point without any tag has an empty array.

    judged: item (a thread, a member's posts or a group), tags; one row an item.
    """
    rows = presences
    for at, name in (("thread", "__t"), ("posts", "__p"), ("group_id", "__g")):
        rows = rows.join(judged.select(F.col("item").alias(at), F.col("tags").alias(name)), at, "left")
    softened = F.transform("__g", lambda t: F.when(t == "personal_to_user", "personal_not_to_user").otherwise(t))
    tool = F.when(F.col("source").isin(*BRAND_TOOLS) & ~F.coalesce("empty_customer", F.lit(False)), F.array(F.lit("professional_to_brand")))
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(x, none) for x in (F.col("__t"), F.coalesce("__p", softened), tool)])
    return rows.select("person_id", "point", F.explode_outer(every).alias("tag")).groupBy("person_id", "point").agg(in_order(F.collect_set("tag")).alias("tags"))


def capacity(tags: Column) -> Column:
    """professional to the brand, else personal, else professional; null where not judged."""
    has = lambda t: F.array_contains(tags, t)
    return F.when(has(TAGS[2]), "professional").when(has(TAGS[0]) | has(TAGS[1]), "personal").when(has(TAGS[3]), "professional")


def relation_key(person: Column, capacity: Column, company: Column) -> Column:
    kind = F.when(capacity == "personal", "personal").when(company.isNotNull(), F.concat(F.lit("org:"), company)).otherwise("pro")
    return F.concat_ws(":", F.lit("rel"), person, kind)


def standing(corrections: DataFrame) -> DataFrame:
    """A person's statements that were not undone, as one array in stated order."""
    s = corrections.where("undone_at is null and person_id is not null and kind <> 'domain_kind'")
    one = F.struct("stated_at", "correction_id", "kind", "tag", "company", "domain", "point")
    return s.groupBy("person_id").agg(F.sort_array(F.collect_list(one)).alias("stated"))


def _tagged(tags: Column, stated: Column, point: Column) -> Column:
    """A point's tags after the statements; one that names a point is for that point alone."""

    def step(held: Column, s: Column) -> Column:
        mine = s["tag"].isNotNull() & (s["point"].isNull() | (s["point"] == point))
        rid = F.array_remove(held, s["tag"])
        added = F.array_append(F.filter(rid, lambda t: t != _opposite(s["tag"])), s["tag"])
        return F.when(mine & (s["kind"] == "tag_remove"), rid).when(mine & (s["kind"] == "tag_add"), added).otherwise(held)

    return in_order(F.aggregate(stated, tags, step))


def _companies(first: Column, stated: Column, point: Column) -> Column:
    """A point's companies after the statements: an addition that names no point reaches
    only points of unknown company, a removal all of the person's."""

    def step(held: Column, s: Column) -> Column:
        mine = s["company"].isNotNull() & (s["point"].isNull() | (s["point"] == point))
        one = F.struct(s["company"].alias("company"), s["domain"].alias("domain"), F.lit("user").alias("basis"))
        fits = (s["point"].isNotNull() | (F.size(held) == 0)) & ~F.exists(held, lambda c: c["company"] == s["company"])
        rid = F.filter(held, lambda c: c["company"] != s["company"])
        return F.when(mine & (s["kind"] == "organization_add") & fits, F.array_append(held, one)).when(mine & (s["kind"] == "organization_remove"), rid).otherwise(held)

    return F.aggregate(stated, first.cast(COMPANIES), step)


def corrected_points(points: DataFrame, corrections: DataFrame) -> DataFrame:
    """Points (person_id, point, tags, evidence, judged) after the statements: tags,
    capacity, and companies (company, domain, basis), which only professional points have.

    evidence and judged are arrays of (company, domain); what evidence names goes before
    what was judged. Null arrays count as empty. Points without a person id take no
    statement. Other columns are kept.
    """
    none = F.array().cast("array<struct<company:string,domain:string>>")
    based = lambda c, basis: F.transform(F.coalesce(c, none), lambda x: F.struct(x["company"].alias("company"), x["domain"].alias("domain"), F.lit(basis).alias("basis")))
    kept = [c for c in points.columns if c not in ("tags", "evidence", "judged")]
    p = points.join(standing(corrections), "person_id", "left")
    p = p.withColumn("stated", F.coalesce("stated", F.array().cast(p.schema["stated"].dataType)))
    p = p.withColumn("tags", _tagged(F.coalesce("tags", F.array().cast("array<string>")), F.col("stated"), F.col("point")))
    p = p.withColumn("capacity", capacity(F.col("tags")))
    first = F.when(F.size(F.coalesce("evidence", none)) > 0, based(F.col("evidence"), "evidence")).otherwise(based(F.col("judged"), "judged"))
    companies = F.when(F.col("capacity") == "professional", _companies(first, F.col("stated"), F.col("point"))).otherwise(F.array().cast(COMPANIES))
    return p.select(*kept, "tags", "capacity", companies.alias("companies"))


def relations(points: DataFrame) -> DataFrame:
    """Relations (person_id, relation_key, capacity, company, domain, tags, points) of
    corrected points: personal points share one, a professional point joins each of its
    companies' or, without one, the company-less one; a point without capacity joins none."""
    company = F.explode_outer("companies").alias("c")
    rows = points.where("capacity is not null").select("person_id", "point", "tags", "capacity", company)
    rows = rows.withColumn("relation_key", relation_key(F.col("person_id"), F.col("capacity"), F.col("c.company")))
    each = rows.select("person_id", "relation_key", "capacity", F.col("c.company").alias("company"), "c.domain", "point", F.explode_outer("tags").alias("tag"))
    return each.groupBy("person_id", "relation_key", "capacity", "company").agg(
        F.min_by("domain", "point").alias("domain"),
        in_order(F.collect_set("tag")).alias("tags"),  # of four tags
        F.count_distinct("point").alias("points"),
    )


def domain_verdicts(judged: DataFrame, corrections: DataFrame) -> DataFrame:
    """(domain, kind, confidence, company): the last standing statement on a domain, else
    the judgment. A statement of a mailbox provider takes the company away."""
    last = corrections.where("undone_at is null and kind = 'domain_kind' and domain is not null").groupBy("domain").agg(F.max_by(F.struct("domain_kind", "company"), F.struct("stated_at", "correction_id")).alias("s"))
    both = judged.join(last, "domain", "full_outer")
    company = F.when(F.col("s").isNull(), judged["company"]).when(F.col("s.domain_kind") == "mailbox_provider", None).when(F.col("s.domain_kind") == "organization", F.coalesce(F.col("s.company"), judged["company"])).otherwise(judged["company"])
    return both.select("domain", F.coalesce("s.domain_kind", judged["kind"]).alias("kind"), F.when(F.col("s").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), company.alias("company"))


def organisations(presences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(person_id, company, domain, tags, evidence): the companies a person speaks for.

    presences: person_id, tags, evidence_kind, value, domain, one row a piece of evidence.
    A domain counts if it is an organisation with confidence ORGANIZATION_FLOOR or more
    and its company is known; a link exists only if the presence carries a professional tag.
    """
    pro = F.array_intersect("tags", F.array(*map(F.lit, TAGS[2:])))
    p = presences.select("person_id", pro.alias("tags"), "evidence_kind", "value", "domain").where("size(tags) > 0 and domain is not null")
    v = verdicts.where((F.col("kind") == "organization") & (F.col("confidence") >= ORGANIZATION_FLOOR) & F.col("company").isNotNull()).select("domain", "company")
    rows = p.join(v, "domain").select("person_id", "company", "domain", F.explode("tags").alias("tag"), F.concat_ws(":", "evidence_kind", "value").alias("told"))
    return rows.groupBy("person_id", "company").agg(F.min("domain").alias("domain"), in_order(F.collect_set("tag")).alias("tags"), F.count_distinct("told").alias("evidence"))


def standing_merges(merges: DataFrame) -> DataFrame:
    """(a, b) of stated merges that were not undone, smaller id first, once each."""
    m = merges.where("undone_at is null and a is not null and b is not null and a <> b")
    return m.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged_people(people: DataFrame, merges: DataFrame, id_col: str = "person_id") -> DataFrame:
    """people with `merged_into`: the smallest id that stated merges tie a person to
    (chains included), else their own."""
    from factloom.operators.graph import connected_components

    roots = connected_components(standing_merges(merges)).withColumnsRenamed({"node": id_col, "root": "merged_into"})
    return people.join(roots, id_col, "left").withColumn("merged_into", F.coalesce("merged_into", id_col))
