"""Entity resolution: the parties of letters against known profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.functions.text import folded, like_column, pieces, utrim
from mailspan.sources.folders import written

EXACT = 0.95
#: Profiles up to this many rows are broadcast to all needles; beyond, both sides are blocked on pieces of text. Needles that hold
#: no literal character are broadcast up to BROADCAST_NEEDLES.
BROADCAST_PROFILES, BROADCAST_NEEDLES = 2_000, 10_000
#: Lengths of the pieces: a needle takes the longest that it has between wild characters, so that little else has its rarest one.
PIECES = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1)


def parties(fields: DataFrame) -> DataFrame:
    """documentId, role, name, organization, email, phone, address from field rows (with seq): the first field of each name
    counts; a role needs a name or an organization; receivers have neither e-mail nor phone."""
    first = lambda name: F.expr(f"min_by(fieldValue, seq) filter (where fieldName = '{name}')")
    names = {f"{side}_{k.lower()}": first(f"{side} {k}") for side in ("Sender", "Receiver") for k in ("Name", "Organization", "Address", "Phone", "Email")}
    wide = fields.groupBy("documentId").agg(*[v.alias(k) for k, v in names.items()])
    none = "cast(null as string)"
    rows = f"""array(named_struct('role', 'SENDER', 'name', Sender_name, 'organization', Sender_organization, 'email', Sender_email, 'phone', Sender_phone, 'address', Sender_address),
               named_struct('role', 'RECEIVER', 'name', Receiver_name, 'organization', Receiver_organization, 'email', {none}, 'phone', {none}, 'address', Receiver_address))"""
    return wide.select("documentId", F.explode(F.expr(rows)).alias("p")).select("documentId", "p.*").filter("name is not null or organization is not null")


def _trimmed(c: str) -> str:
    return utrim(f"lower({c})")


def _agreement(profile: str, told: str, partly: float) -> str:
    """SQL: 1 for equal when trimmed, `partly` for containment either way, else 0; float32 throughout."""
    a, b = f"lower({profile})", f"lower({told})"
    return f"case when {_trimmed(profile)} = {_trimmed(told)} then 1F when contains({a}, {b}) or contains({b}, {a}) then {partly}F else 0F end"


def confidence(p: str = "p", s: str = "s") -> str:
    """SQL: mean of the checks that both sides allow, of the structs `p` (profile) and `s` (party); 0 without any."""
    checks = [
        (f"{s}.organization is not null and {p}.organization is not null", _agreement(f"{p}.organization", f"{s}.organization", 0.8)),
        (f"{s}.name is not null", _agreement(f"{p}.name", f"{s}.name", 0.7)),
        (f"{s}.email is not null and {p}.email is not null", f"if(lower({p}.email) = lower({s}.email), 1F, 0F)"),
    ]
    total = " + ".join(f"if({when}, {value}, 0F)" for when, value in checks)
    n = " + ".join(f"if({when}, 1, 0)" for when, _ in checks)
    return f"cast(if(({n}) = 0, 0D, ({total}) / ({n})) as float)"


def told_needle(party: DataFrame) -> DataFrame:
    """`party` with the needle that is looked for: the organization, or else the name; and whether it is an organization."""
    return party.withColumn("_needle", F.coalesce("organization", "name")).withColumn("_org", F.col("organization").isNotNull())


def matches(party: DataFrame, profiles: DataFrame, broadcast_profiles: int = BROADCAST_PROFILES) -> DataFrame:
    """needle, org, id: which profiles have which needle in their name, or an organization in their organization.

    Each needle is looked for once, however many parties tell it. Few profiles are broadcast, after a count. Many are
    blocked: what a needle matches has all of its pieces without wild characters, so it is looked for among the profiles
    with the rarest of its longest ones. Pieces of one short length would each occur in a share of all profiles, and the
    work grow with the square of their number. Needles of wild characters alone meet all profiles.
    """
    needles = told_needle(party).select(F.col("_needle").alias("needle"), F.col("_org").alias("org")).filter("needle is not null").distinct()
    p = profiles.select("id", "name", "organization")
    contained = lambda c: f"contains({folded(c)}, {folded('needle')})"
    found = lambda c: f"if(needle rlike '[%_]', {like_column(c, 'needle')}, {contained(c)})"
    hit = F.expr(f"coalesce({found('name')}, false) or (org and coalesce({found('organization')}, false))")
    if profiles.count() <= broadcast_profiles:
        return needles.join(F.broadcast(p), hit).select("needle", "org", "id")
    longest = "array_max(transform(split(needle, '[%_]'), x -> length(x)))"
    size = f"case {' '.join(f'when {longest} >= {n} then {n}' for n in PIECES)} else 0 end"
    needles = written(needles.withColumn("size", F.expr(size)), "needles")
    found = blocked(needles, p).filter(hit).select("needle", "org", "id")
    loose = needles.filter("size = 0").select("needle", "org")
    n = loose.count()
    return found.union(p.join(F.broadcast(loose) if n <= BROADCAST_NEEDLES else loose, hit).select("needle", "org", "id")) if n else found


def blocked(needles: DataFrame, profiles: DataFrame) -> DataFrame:
    """needle, org, id, name, organization: the profiles that have the rarest piece of a needle, a piece of its `size`."""
    sizes = sorted(r.size for r in needles.filter("size > 0").select("size").distinct().collect())  # no more than there are lengths
    own = f"case size {' '.join(f'when {n} then {pieces("needle", n)}' for n in PIECES)} end"
    asked = needles.filter("size > 0").select("needle", "org", F.explode(F.array_distinct(F.expr(f"filter({own}, x -> not x rlike '[%_]')"))).alias("piece"))
    both = F.expr(r"concat(coalesce(name, ''), '\0', coalesce(organization, ''))")
    every = F.expr(f"array_distinct(concat(cast(array() as array<string>), {', '.join([pieces('_both', n) for n in sizes] or ['array()'])}))")
    index = profiles.withColumn("_both", both).withColumn("piece", F.explode_outer(every)).filter("piece is not null").drop("_both")
    often = index.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "piece", "left").groupBy("needle", "org").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
    return rarest.join(index, "piece").drop("piece")


def candidates(party: DataFrame, profiles: DataFrame, broadcast_profiles: int = BROADCAST_PROFILES) -> DataFrame:
    """All (party, profile) pairs in which the party's organization, or else its name, occurs in the profile's name, or the
    organization in the profile's organization. Structs s and p."""
    told = told_needle(party).select(F.struct(*party.columns).alias("s"), "_needle", "_org")
    found = matches(party, profiles, broadcast_profiles)
    whole = profiles.select(F.col("id").alias("_id"), F.struct(*profiles.columns).alias("p"))
    return told.join(found, (F.col("_needle") == F.col("needle")) & (F.col("_org") == F.col("org"))).join(whole, F.col("id") == F.col("_id")).select("s", "p")


def suggestions(party: DataFrame, profiles: DataFrame, order: str = "createdAt", broadcast_profiles: int = BROADCAST_PROFILES, found: DataFrame | None = None) -> DataFrame:
    """A row for each party: what was told, profileId, confidence, matchType. `found`: matches that are known already.

    Of all candidates the profile that was inserted first counts, not the best one; a party without candidates is a
    new profile with confidence 0.
    """
    whole = profiles.select(F.col("id").alias("_id"), F.struct(*profiles.columns).alias("p"))
    found = matches(party, profiles, broadcast_profiles) if found is None else found
    pairs = found.join(whole, F.col("id") == F.col("_id"))
    # the first candidate by insertion order, once for each needle: an aggregate, so that no task ever holds all of them
    first = pairs.groupBy("needle", "org").agg(F.min_by("p", F.struct(F.col(f"p.{order}"), F.col("p.id"))).alias("p"))
    told = told_needle(party).withColumn("s", F.struct(*party.columns))
    out = told.join(first, (F.col("_needle") == F.col("needle")) & (F.col("_org") == F.col("org")), "left")
    sure = F.when(F.col("p").isNotNull(), F.expr(confidence("p", "s"))).otherwise(F.lit(0).cast("float"))
    kind = F.when(F.col("p").isNull(), "NEW_PROFILE").when(F.col("confidence") >= F.lit(EXACT).cast("float"), "EXACT_MATCH").otherwise("POSSIBLE_MATCH")
    out = out.select(*party.columns, F.col("p.id").alias("profileId"), sure.alias("confidence"), "p")
    return out.withColumn("matchType", kind).drop("p")


def auto_links(suggested: DataFrame, now: int) -> DataFrame:
    """Links of the exact matches; a profile that has two roles in a document keeps the last."""
    exact = suggested.filter("matchType = 'EXACT_MATCH'")
    last = exact.groupBy("documentId", "profileId").agg(F.max_by("role", F.when(F.col("role") == "SENDER", 0).otherwise(1)).alias("role"))
    return last.withColumn("createdAt", F.lit(now).cast("long"))


def filled_profiles(profiles: DataFrame, suggested: DataFrame, now: int) -> DataFrame:
    """Profiles after linking: phone, e-mail and street filled where missing (by the first document that has them), and
    modifiedAt set for every linked one."""
    linked = suggested.filter(F.col("profileId").isNotNull())
    first = lambda c: F.expr(f"min_by({c}, struct(documentId, role)) filter (where {c} is not null)")
    told = linked.groupBy(F.col("profileId").alias("_id")).agg(first("phone").alias("_phone"), first("email").alias("_email"), first("address").alias("_street"))
    w = profiles.join(told, profiles["id"] == F.col("_id"), "left")
    new = {c: F.coalesce(profiles[c], F.col(f"_{c}")) for c in ("phone", "email", "street") if c in profiles.columns}
    if "modifiedAt" in profiles.columns:
        new["modifiedAt"] = F.when(F.col("_id").isNotNull(), F.lit(now).cast("long")).otherwise(profiles["modifiedAt"])
    return w.select(*[new.get(c, profiles[c]).alias(c) for c in profiles.columns])


def created_profiles(suggested: DataFrame, now: int) -> DataFrame:
    """Profiles of the new parties: authorities where there is an organization, else persons; a nameless one is Unknown."""
    new = suggested.filter("matchType = 'NEW_PROFILE'")
    return new.select(
        F.sha2(F.concat_ws("|", "documentId", "role"), 256).alias("id"),
        F.when(F.col("organization").isNotNull(), "AUTHORITY").otherwise("PERSON").alias("type"),
        F.coalesce("organization", "name", F.lit("Unknown")).alias("name"), "organization", F.col("address").alias("street"), "phone", "email",
        F.lit(now).cast("long").alias("createdAt"), F.lit(now).cast("long").alias("modifiedAt"), "documentId", "role",
    )


def rank_by_confidence(pairs: DataFrame) -> DataFrame:
    """All candidates of a party by confidence, for a user to choose from."""
    w = pairs.select(F.col("s.documentId").alias("documentId"), F.col("s.role").alias("role"), F.col("p.id").alias("profileId"), F.expr(confidence()).alias("confidence"))
    return w.withColumn("rank", F.row_number().over(W.partitionBy("documentId", "role").orderBy(F.desc("confidence"), "profileId")))
