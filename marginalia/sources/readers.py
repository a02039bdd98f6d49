"""Bulk dumps to tables. Every ``parse_x`` takes a DataFrame with one JSON (or
html) document per row in ``raw``; ``read_x`` reads such files from a path.
Schemas are stated, so nothing is inferred and unknown fields are dropped at
the scan; malformed documents yield no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.identifiers import blank_to_null, entity_id
from marginalia.functions.licences import code_from_slug, code_from_uri, usage_code
from marginalia.functions.markup import strip_tags
from marginalia.sources.jsonmap import SPLIT_BYTES, JsonMap

ARTICLE = (
    "page_id bigint, title string, html string, wikitext string, templates array<string>, "
    "externallinks array<string>, "
    "sections array<struct<index:string,level:int,title:string,anchor:string,offset:int>>"
)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per line: splittable, so one big file is many tasks."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("raw"), F.input_file_name().alias("file")
    )


def parse_articles(raw: DataFrame) -> DataFrame:
    doc = F.from_json("raw", ARTICLE)
    return raw.select(doc.alias("d")).select("d.*").filter("page_id IS NOT NULL")


def read_articles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(ARTICLE).format(fmt).load(path)


_STATEMENT = (
    "struct<rank:string,mainsnak:struct<datavalue:struct<type:string,value:string>>,"
    "qualifiers:map<string,string>,references:array<string>>"
)


def parse_entity_claims(raw: DataFrame) -> DataFrame:
    """One row per statement. The value is an entity id, a text, or a point;
    kind tells which; other values (quantities, times) keep their text."""
    doc = F.from_json("raw", f"struct<id:string,claims:map<string,array<{_STATEMENT}>>>")
    by_property = raw.select(doc.alias("d")).select(
        F.col("d.id").alias("qid"), F.explode("d.claims").alias("property", "statements")
    )
    s, value = F.col("s"), F.col("s.mainsnak.datavalue.value")
    kind = F.col("s.mainsnak.datavalue.type")
    is_entity, is_point = kind == "wikibase-entityid", kind == "globecoordinate"
    return (
        by_property.select("qid", "property", F.posexplode("statements").alias("_pos", "s"))
        .filter(value.isNotNull())
        .select(
            "qid", "property",
            (F.col("_pos") + 1).cast("bigint").alias("ord"),
            s["rank"].alias("rank"),
            F.when(is_entity, "entity").when(is_point, "point").when(kind == "time", "time")
            .when(kind == "string", "string").otherwise("other").alias("kind"),
            F.when(is_entity, F.get_json_object(value, "$.id")).alias("value_id"),
            F.when(kind == "time", F.get_json_object(value, "$.time"))
            .when(~is_entity & ~is_point, value).alias("value_str"),
            F.when(is_point, F.get_json_object(value, "$.latitude").try_cast("double")).alias("lat"),
            F.when(is_point, F.get_json_object(value, "$.longitude").try_cast("double")).alias("lon"),
            s["qualifiers"].alias("qualifiers"),
            F.coalesce(F.size(s["references"]), F.lit(0)).cast("bigint").alias("reference_count"),
        )
    )


def read_entity_claims(spark: SparkSession, path: str) -> DataFrame:
    return parse_entity_claims(raw_lines(spark, path))


def parse_sparql_bindings(raw: DataFrame, variables: Sequence[str], item: str) -> DataFrame:
    """Result rows to columns; entity URIs to their ids; rows whose ``item``
    is no entity are dropped."""
    doc = F.from_json("raw", "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>")
    rows = raw.select(F.explode(doc["results"]["bindings"]).alias("b"))

    def plain(variable: str) -> Column:
        value = F.try_element_at("b", F.lit(variable))["value"]
        return F.when(value.rlike(r"/entity/Q\d+$"), entity_id(value)).otherwise(value).alias(variable)

    return rows.select(*[plain(v) for v in variables]).filter(F.col(item).rlike(r"^Q\d+$"))


def read_sparql_bindings(spark: SparkSession, path: str, variables: Sequence[str], item: str) -> DataFrame:
    return parse_sparql_bindings(raw_lines(spark, path), variables, item)


# --- holding records ---------------------------------------------------------

CC0 = "https://creativecommons.org/publicdomain/zero/1.0/"
HOLDING = (
    "partner", "id", "title", "creator", "date", "medium", "dimensions", "accession", "credit",
    "public_domain", "rights_label", "rights_uri", "image_url", "image_count", "href", "institution", "providers",
)

# Names of the museums whose record layouts are read.
INSTITUTIONS = {
    "met": "The Metropolitan Museum of Art",
    "artic": "Art Institute of Chicago",
    "rijks": "Rijksmuseum",
    "cleveland": "Cleveland Museum of Art",
    "getty": "J. Paul Getty Museum",
}


def _holding(rows: DataFrame, partner: str, public: Column, image: Column, **fields: Column) -> DataFrame:
    """The common holding row; an image counts only for open works."""
    public = F.coalesce(public, F.lit(False))
    base = {
        "partner": F.lit(partner),
        "public_domain": public,
        "rights_label": F.when(public, "CC0"),
        "rights_uri": F.when(public, CC0),
        "image_url": F.when(public, blank_to_null(image)),
        "institution": F.lit(INSTITUTIONS.get(partner)),
        "image_count": F.lit(None).cast("int"),
        "providers": F.lit(1),
        **{name: blank_to_null(col) if name not in ("image_count", "providers", "public_domain") else col for name, col in fields.items()},
    }
    null = F.lit(None).cast("string")
    return rows.select(*[base.get(name, null).alias(name) for name in HOLDING])


def _parsed(raw: DataFrame, schema: str, document: Column | str = "raw") -> DataFrame:
    return raw.select(F.from_json(document, schema).alias("d")).filter("d IS NOT NULL")


def _met(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "struct<objectID:string,isPublicDomain:boolean,title:string,artistDisplayName:string,objectDate:string,medium:string,dimensions:string,accessionNumber:string,creditLine:string,primaryImage:string,primaryImageSmall:string,additionalImages:array<string>,objectURL:string>")
    small, full = (blank_to_null(F.col(f"d.{c}")) for c in ("primaryImageSmall", "primaryImage"))
    images = F.coalesce(small, full).isNotNull().cast("int") + F.coalesce(F.size("d.additionalImages"), F.lit(0))
    return _holding(
        rows, "met", F.col("d.isPublicDomain"), F.coalesce(small, full),
        id=F.col("d.objectID"), title=F.col("d.title"), creator=F.col("d.artistDisplayName"), date=F.col("d.objectDate"),
        medium=F.col("d.medium"), dimensions=F.col("d.dimensions"), accession=F.col("d.accessionNumber"),
        credit=F.col("d.creditLine"), image_count=images, href=F.col("d.objectURL"),
    )


def _artic(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "struct<data:struct<id:string,is_public_domain:boolean,image_id:string,alt_image_ids:array<string>,title:string,artist_display:string,date_display:string,medium_display:string,dimensions:string,main_reference_number:string,credit_line:string>,config:struct<iiif_url:string>>")
    server = F.coalesce("d.config.iiif_url", F.lit("https://www.artic.edu/iiif/2"))
    image = F.concat(server, F.lit("/"), "d.data.image_id", F.lit("/full/800,/0/default.jpg"))
    images = F.col("d.data.image_id").isNotNull().cast("int") + F.coalesce(F.size("d.data.alt_image_ids"), F.lit(0))
    return _holding(
        rows, "artic", F.col("d.data.is_public_domain"), image,
        id=F.col("d.data.id"), title=F.col("d.data.title"), creator=F.substring_index("d.data.artist_display", "\n", 1),
        date=F.col("d.data.date_display"), medium=F.col("d.data.medium_display"), dimensions=F.col("d.data.dimensions"),
        accession=F.col("d.data.main_reference_number"), credit=F.col("d.data.credit_line"), image_count=images,
        href=F.concat(F.lit("https://www.artic.edu/artworks/"), "d.data.id"),
    )


def _cleveland(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "struct<data:struct<accession_number:string,share_license_status:string,title:string,creators:array<struct<description:string>>,creation_date:string,technique:string,measurements:string,creditline:string,images:struct<web:struct<url:string>>,alternate_images:array<string>,url:string>>").filter("d.data IS NOT NULL")
    image = blank_to_null(F.col("d.data.images.web.url"))
    images = image.isNotNull().cast("int") + F.coalesce(F.size("d.data.alternate_images"), F.lit(0))
    return _holding(
        rows, "cleveland", F.col("d.data.share_license_status") == "CC0", image,
        id=F.col("d.data.accession_number"), title=F.col("d.data.title"),
        creator=F.get("d.data.creators", F.lit(0))["description"], date=F.col("d.data.creation_date"),
        medium=F.col("d.data.technique"), dimensions=F.col("d.data.measurements"), accession=F.col("d.data.accession_number"),
        credit=F.col("d.data.creditline"), image_count=images, href=F.col("d.data.url"),
    )


LD_JSON = r'(?s)<script type="application/ld\+json">(.*?)</script>'


def _getty(raw: DataFrame) -> DataFrame:
    rows = _parsed(
        raw,
        "struct<url:string,name:string,license:string,creator:array<struct<name:string>>,temporal:string,material:string,size:string,identifier:array<string>,thumbnailUrl:string>",
        F.regexp_extract("raw", LD_JSON, 1),
    )
    href = blank_to_null(F.col("d.url"))
    return _holding(
        rows, "getty", code_from_uri(F.col("d.license")) == "CC0",
        F.regexp_replace("d.thumbnailUrl", r"/full/![0-9,]+/", "/full/!800,800/"),
        id=F.element_at(F.split(F.regexp_replace(href, "/+$", ""), "/"), -1), title=F.col("d.name"),
        creator=F.get("d.creator", F.lit(0))["name"], date=F.col("d.temporal"), medium=F.col("d.material"),
        dimensions=F.col("d.size"), accession=F.get("d.identifier", F.lit(0)), href=href,
    )


_TAG = "array<struct<id:string>>"
_NAME = f"struct<type:string,content:string,language:{_TAG},classified_as:{_TAG}>"
# Vocabulary terms for English, a primary name, an accession number.
ENGLISH, PRIMARY_NAME, ACCESSION_NUMBER = (
    "http://vocab.getty.edu/aat/300388277", "http://vocab.getty.edu/aat/300404670", "http://vocab.getty.edu/aat/300312355",
)


def _rijks(raw: DataFrame) -> DataFrame:
    """Three linked documents per object: {id, object, visual, digital}."""
    rows = _parsed(raw, f"struct<id:string,object:struct<identified_by:array<{_NAME}>,produced_by:struct<timespan:array<struct<identified_by:array<{_NAME}>>>>>,visual:struct<subject_to:array<struct<classified_as:{_TAG}>>>,digital:struct<access_point:array<struct<id:string>>>>").filter("d.object IS NOT NULL")

    def tagged(n: Column, field: str, term: str) -> Column:
        return F.coalesce(F.exists(n[field], lambda t: t["id"] == term), F.lit(False))

    def names(of: Column) -> Column:
        return F.filter(of, lambda n: (n["type"] == "Name") & (F.trim(n["content"]) != ""))

    def best(of: Column, primary: bool) -> Column:
        english = F.filter(names(of), lambda n: tagged(n, "language", ENGLISH))
        picks = [F.get(english, F.lit(0)), F.get(names(of), F.lit(0))]
        if primary:
            picks.insert(0, F.get(F.filter(english, lambda n: tagged(n, "classified_as", PRIMARY_NAME)), F.lit(0)))
        return F.coalesce(*picks)["content"]

    identified = F.col("d.object.identified_by")
    number = F.get(
        F.filter(identified, lambda n: (n["type"] == "Identifier") & tagged(n, "classified_as", ACCESSION_NUMBER) & (F.trim(n["content"]) != "")),
        F.lit(0),
    )["content"]
    uri = F.get(F.get("d.visual.subject_to", F.lit(0))["classified_as"], F.lit(0))["id"]
    code = code_from_uri(uri)
    file = F.get("d.digital.access_point", F.lit(0))["id"]
    base = F.regexp_extract(file, r"^(https?://\S+?)/full/[^/]+/[^/]+/\w+\.\w+$", 1)
    page = F.when(
        blank_to_null(number).isNotNull(), F.concat(F.lit("https://www.rijksmuseum.nl/en/collection/"), F.url_encode(F.trim(number)))
    ).otherwise(F.concat(F.lit("https://id.rijksmuseum.nl/"), "d.id"))
    return _holding(
        rows, "rijks", code.isin("CC0", "PDM"),
        F.when(base != "", F.concat(base, F.lit("/full/800,/0/default.jpg"))),
        id=F.col("d.id"), title=best(identified, True),
        date=best(F.get("d.object.produced_by.timespan", F.lit(0))["identified_by"], False),
        accession=number, href=page, rights_label=code, rights_uri=F.when(code.isNotNull(), uri),
    )


def manifest_text(value: Column) -> Column:
    """Plain text of a manifest value in any of its shapes, nested to any depth: text, list,
    language map, or {"@value": text}. Of a language map the English text, else the one without a language,
    else that of the least language code. What is not JSON although it begins like it is null."""
    nested = F.ltrim(value).rlike(r"^[\[{]")
    depth = F.length(value) - F.length(F.translate(value, "[{", ""))  # no value lies deeper than it has opening brackets

    def inside(v: Column) -> Column:
        def part(path: str) -> Column:
            found = F.try_variant_get(v, path, "variant")
            return F.when(~F.is_variant_null(found), found)

        def first(entries: Column) -> Column:
            return F.try_element_at(entries, F.try_element_at(F.array_sort(F.map_keys(entries)), F.lit(1)))

        any_ = first(F.try_variant_get(v, "$", "map<string,variant>"))
        return F.coalesce(part("$['@value']"), part("$.en"), part("$.none"), part("$[0]"), any_)

    def step(v: Column, _: Column) -> Column:
        return F.when(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)<"), inside(v)).otherwise(v)

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.try_parse_json(value), step)
    found = F.when(~F.schema_of_variant(walked).rlike("^(ARRAY|OBJECT)<"), F.try_variant_get(walked, "$", "string"))
    return blank_to_null(strip_tags(F.when(nested, found).otherwise(value)))


def _iiif(raw: DataFrame) -> DataFrame:
    """Manifests of both versions; the document's url is in ``url``."""
    j = lambda path: F.get_json_object("raw", path)
    stated = [F.when(~F.ltrim(v).rlike(r"^[\[{]"), v) for v in (j("$.rights[0]"), j("$.rights"), j("$.license[0]"), j("$.license"))]
    uri = F.coalesce(*stated)
    code = code_from_uri(uri)

    def service(root: str) -> Column:
        return F.coalesce(*[j(f"{root}.service{i}{k}") for i in ("[0]", "") for k in ("['@id']", ".id")])

    v3, v2 = "$.items[0].items[0].items[0].body", "$.sequences[0].canvases[0].images[0].resource"
    base = F.when(j(v3).isNotNull(), service(v3)).otherwise(service(v2))
    home = F.coalesce(
        *[j(f"$.homepage{i}{k}") for i in ("[0]", "") for k in (".id", "['@id']")],
        *[j(f"$.related{i}['@id']") for i in ("[0]", "")],
        F.when(~F.ltrim(j("$.related")).rlike(r"^[\[{]"), j("$.related")),
        F.col("url"),
    )
    count = F.json_array_length(F.coalesce(j("$.items"), j("$.sequences[0].canvases")))
    providers = F.coalesce(F.json_array_length(j("$.provider")), F.when(j("$.provider").isNotNull(), 1), F.lit(0))
    one = F.when(F.json_array_length(j("$.provider")) == 1, manifest_text(j("$.provider[0].label")))
    said = F.concat_ws(": ", manifest_text(j("$.requiredStatement.label")), manifest_text(j("$.requiredStatement.value")))
    credit = F.coalesce(blank_to_null(said), manifest_text(j("$.attribution")))
    rows = raw.filter(F.ltrim("raw").startswith("{"))
    return _holding(
        rows, "iiif", code.isin("CC0", "PDM"), F.concat(base, F.lit("/full/800,/0/default.jpg")),
        id=F.col("url"), title=manifest_text(j("$.label")), credit=credit, rights_label=code, rights_uri=uri,
        image_count=count, href=home, institution=one, providers=providers,
    )


HOLDING_READERS = {
    "met": _met, "artic": _artic, "cleveland": _cleveland, "getty": _getty, "rijks": _rijks, "iiif": _iiif,
}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def parse_holdings(raw: dict[str, DataFrame]) -> DataFrame:
    """Records of several partners in one schema. Adding a partner is one more
    reader in ``HOLDING_READERS``."""
    return _union([HOLDING_READERS[partner](frame) for partner, frame in raw.items()])


def read_holdings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    whole = {"getty", "iiif"}
    return parse_holdings({
        p: raw_files(spark, path).withColumnRenamed("file", "url") if p in whole else raw_lines(spark, path)
        for p, path in paths.items()
    })


# --- aggregators ---------------------------------------------------------------

ENTRY = ("source", "id", "title", "provider", "subjects", "rights_uri", "rights_code", "image_url", "href", "models", "names", "scan_subject")


def first_value(document: Column, path: str) -> Column:
    """A field that may be one value or a list: the first."""
    plain = F.get_json_object(document, path)
    return F.when(F.ltrim(plain).startswith("["), F.get_json_object(document, f"{path}[0]")).otherwise(plain)


def all_values(document: Column, path: str) -> Column:
    plain = F.get_json_object(document, path)
    many = F.filter(F.from_json(plain, "array<string>"), lambda v: v.isNotNull())
    return F.when(F.ltrim(plain).startswith("["), many).when(plain.isNotNull(), F.array(plain)).otherwise(
        F.array().cast("array<string>")
    )


def _entry(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    base = {"subjects": empty, "names": empty, "models": F.lit(0).cast("bigint"), **fields, "source": F.lit(source)}
    null = F.lit(None).cast("string")
    out = rows.select(*[base.get(name, null).alias(name) for name in ENTRY])
    return out.filter("title IS NOT NULL AND href IS NOT NULL")


def _dpla(raw: DataFrame) -> DataFrame:
    d = F.col("raw")
    one = lambda p: first_value(d, p)
    uri = one("$.rights")
    stated = F.when(code_from_uri(uri).isNotNull(), uri).otherwise(one("$['sourceResource.rights']"))
    ident = F.get_json_object(d, "$.id")
    return _entry(
        raw, "dpla", id=ident, title=blank_to_null(one("$['sourceResource.title']")),
        provider=F.coalesce(F.get_json_object(one("$.dataProvider"), "$.name"), one("$.dataProvider")),
        subjects=all_values(d, "$['sourceResource.subject.name']"), rights_uri=stated, rights_code=code_from_uri(stated),
        image_url=one("$.object"),
        href=F.coalesce(F.concat(F.lit("https://dp.la/item/"), ident), one("$.isShownAt")),
    )


def _europeana(raw: DataFrame) -> DataFrame:
    one = lambda p: first_value(F.col("raw"), p)
    return _entry(
        raw, "europeana", id=one("$.id"), title=blank_to_null(one("$.title")), provider=one("$.dataProvider"),
        rights_uri=one("$.rights"), rights_code=code_from_uri(one("$.rights")), image_url=one("$.edmPreview"), href=one("$.guid"),
    )


def _digitalnz(raw: DataFrame) -> DataFrame:
    d = F.col("raw")
    one = lambda p: first_value(d, p)
    return _entry(
        raw, "digitalnz", id=one("$.id"), title=blank_to_null(one("$.title")), provider=one("$.content_partner"),
        subjects=all_values(d, "$.subject"), rights_code=usage_code(all_values(d, "$.usage")),
        image_url=F.coalesce(one("$.large_thumbnail_url"), one("$.thumbnail_url")),
        href=F.coalesce(F.concat(F.lit("https://digitalnz.org/records/"), one("$.id")), one("$.landing_url")),
    )


def _smithsonian(raw: DataFrame) -> DataFrame:
    schema = (
        "struct<id:string,title:string,url:string,content:struct<descriptiveNonRepeating:struct<record_link:string,data_source:string,"
        "online_media:struct<media:array<struct<type:string,content:string,usage:struct<access:string>,resources:array<struct<name:string>>>>>>,"
        "indexedStructured:struct<scientific_name:array<string>>>>"
    )
    rows = _parsed(raw, schema)
    media = F.col("d.content.descriptiveNonRepeating.online_media.media")
    models = F.filter(media, lambda m: (m["type"] == "3d_voyager") & m["content"].isNotNull())
    image = F.get(F.filter(media, lambda m: (m["type"] == "Images") & m["content"].isNotNull()), F.lit(0))["content"]
    access = F.get(F.filter(media, lambda m: m["usage"]["access"].isNotNull()), F.lit(0))["usage"]["access"]
    scan = F.filter(
        F.flatten(F.transform(F.filter(media, lambda m: m["type"] == "3d_voyager"), lambda m: F.coalesce(m["resources"], F.array()))),
        lambda r: F.trim(r["name"]) != "",
    )
    # "Gorilla: gorilla: skull" names the animal twice
    parts = F.transform(F.split(F.trim(F.get(scan, F.lit(0))["name"]), ":"), lambda t: F.trim(t))
    kept = F.filter(parts, lambda p, i: (i == 0) | (F.lower(p) != F.lower(F.get(parts, F.greatest(i - 1, F.lit(0))))))
    return _entry(
        rows, "smithsonian", id=F.col("d.id"), title=blank_to_null(F.col("d.title")), provider=F.col("d.content.descriptiveNonRepeating.data_source"),
        rights_uri=F.when(access == "CC0", CC0), rights_code=F.when(access == "CC0", "CC0"),
        image_url=F.concat(image, F.when(image.contains("?"), "&").otherwise("?"), F.lit("max=800")),
        href=F.col("d.content.descriptiveNonRepeating.record_link"),
        models=F.coalesce(F.size(models), F.lit(0)).cast("bigint"),
        names=F.coalesce("d.content.indexedStructured.scientific_name", F.array().cast("array<string>")),
        scan_subject=F.array_join(kept, ": "),
    )


AGGREGATOR_READERS = {"dpla": _dpla, "europeana": _europeana, "digitalnz": _digitalnz, "smithsonian": _smithsonian}


def parse_aggregator_docs(raw: dict[str, DataFrame]) -> DataFrame:
    return _union([AGGREGATOR_READERS[source](frame) for source, frame in raw.items()])


def read_aggregator_docs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return parse_aggregator_docs({s: raw_lines(spark, path) for s, path in paths.items()})


# --- bibliographic catalogues ----------------------------------------------------


def _archive_docs(raw: DataFrame) -> DataFrame:
    d = F.col("raw")
    return raw.select(
        F.get_json_object(d, "$.identifier").alias("doc_id"), first_value(d, "$.title").alias("title"),
        first_value(d, "$.creator").alias("creator"), first_value(d, "$.year").alias("year"),
        all_values(d, "$.isbn").alias("isbns"), code_from_uri(first_value(d, "$.licenseurl")).alias("licence"),
    ).filter("doc_id IS NOT NULL")


def _volumes(raw: DataFrame) -> DataFrame:
    """{"ISBN:x": {url, ebooks}} to one row per book and how it can be read."""
    schema = "map<string,struct<url:string,ebooks:array<struct<availability:string,read_url:string,preview_url:string>>>>"
    rows = raw.select(F.explode(F.from_json("raw", schema)).alias("key", "v"))
    ebook = F.get("v.ebooks", F.lit(0))
    catalog = F.regexp_replace("v.url", "^http:", "https:")
    state = F.when(ebook["availability"].isin("full", "borrow"), ebook["availability"]).when(catalog.isNotNull(), "catalog")
    return rows.select(
        F.regexp_replace("key", "^ISBN:", "").alias("isbn"), state.alias("availability"),
        F.when(ebook["availability"] == "full", F.coalesce(ebook["read_url"], ebook["preview_url"], catalog))
        .when(ebook["availability"] == "borrow", F.coalesce(ebook["preview_url"], catalog)).otherwise(catalog).alias("url"),
    ).filter("availability IS NOT NULL")


def _author_works(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "struct<key:string,title:string,ebook_access:string,first_publish_year:int,cover_i:bigint,ia:array<string>,author_key:array<string>,edition_count:bigint>")
    return rows.filter("d.title IS NOT NULL").select(
        "d.key", "d.title", "d.ebook_access", F.col("d.edition_count").alias("editions"),
        F.when(F.col("d.ebook_access") != "no_ebook", F.get("d.ia", F.lit(0))).alias("scan_id"),
        F.when(F.col("d.cover_i") > 0, F.col("d.cover_i")).alias("cover"),
        F.explode_outer("d.author_key").alias("author"), (F.size("d.author_key") == 1).alias("sole_author"),
    )


def _papers(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "struct<id:string,doi:string,ids:struct<pmid:string>,title:string,publication_year:int,open_access:struct<is_oa:boolean,oa_url:string,oa_status:string>,authorships:array<struct<author:struct<display_name:string,orcid:string>>>,best_oa_location:struct<license:string>,cited_by_count:bigint,is_retracted:boolean>")
    return rows.select(
        F.col("d.id").alias("work_id"), "d.doi", F.element_at(F.split("d.ids.pmid", "/"), -1).alias("pmid"), "d.title",
        F.col("d.publication_year").alias("year"), "d.open_access.is_oa", "d.open_access.oa_url", "d.open_access.oa_status",
        F.col("d.best_oa_location.license").alias("licence_slug"), code_from_slug(F.col("d.best_oa_location.license")).alias("licence"),
        F.col("d.cited_by_count").alias("cited_by"), F.coalesce("d.is_retracted", F.lit(False)).alias("is_retracted"),
        F.get("d.authorships", F.lit(0))["author"]["display_name"].alias("first_author"),
        F.transform("d.authorships", lambda a: a["author"]["orcid"]).alias("orcids"),
    ).filter("work_id IS NOT NULL")


def _notices(raw: DataFrame) -> DataFrame:
    """Update notices in both directions: what updates a work (updated-by) and
    what a notice updates (update-to)."""
    item = "array<struct<type:string,source:string,DOI:string>>"
    rows = _parsed(raw, f"struct<message:struct<DOI:string,`updated-by`:{item},`update-to`:{item}>>")
    by = rows.select(F.col("d.message.DOI").alias("doi"), F.explode("d.message.updated-by").alias("u")).withColumn("direction", F.lit("updated-by"))
    to = rows.select(F.col("d.message.DOI").alias("doi"), F.explode("d.message.update-to").alias("u")).withColumn("direction", F.lit("update-to"))
    return by.unionByName(to).select("doi", "direction", "u.type", "u.source", F.col("u.DOI").alias("other"))


BIBLIOGRAPHIC_READERS = {
    "archive": _archive_docs, "volumes": _volumes, "author_works": _author_works, "papers": _papers, "notices": _notices,
}


def parse_bibliographic(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {kind: BIBLIOGRAPHIC_READERS[kind](frame) for kind, frame in raw.items()}


def read_bibliographic(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return parse_bibliographic({k: raw_lines(spark, path) for k, path in paths.items()})


# --- species -----------------------------------------------------------------

OPEN_PHOTO = ("cc0", "pd", "cc-by", "cc-by-sa")


def parse_taxa(raw: dict[str, DataFrame]) -> DataFrame:
    """Species of an observation site (with the first freely licensed photo,
    else the first licensed one) and of an occurrence catalogue."""
    frames = []
    if "inaturalist" in raw:
        photo = "struct<license_code:string,medium_url:string,attribution:string>"
        rows = _parsed(raw["inaturalist"], f"struct<id:string,name:string,preferred_common_name:string,observations_count:bigint,default_photo:{photo},taxon_photos:array<struct<photo:{photo}>>>").filter("d.name IS NOT NULL")
        more = F.transform(F.coalesce("d.taxon_photos", F.array().cast(f"array<struct<photo:{photo}>>")), lambda t: t["photo"])
        candidates = F.array_compact(F.concat(F.array("d.default_photo"), more))
        licensed = F.filter(candidates, lambda p: p["medium_url"].isNotNull() & p["license_code"].isNotNull())
        free = F.filter(licensed, lambda p: p["license_code"].isin(*OPEN_PHOTO))
        pick = F.coalesce(F.get(free, F.lit(0)), F.get(licensed, F.lit(0)))
        frames.append(rows.select(
            F.lit("inaturalist").alias("source"), "d.id",
            F.when(F.col("d.preferred_common_name").isNotNull(), F.format_string("%s (%s)", "d.preferred_common_name", "d.name")).otherwise(F.col("d.name")).alias("title"),
            F.col("d.observations_count").alias("count"), pick["medium_url"].alias("image_url"),
            code_from_slug(pick["license_code"]).alias("licence"), pick["attribution"].alias("attribution"),
            F.concat(F.lit("https://www.inaturalist.org/taxa/"), "d.id").alias("href"),
        ))
    if "gbif" in raw:
        rows = _parsed(raw["gbif"], "struct<key:string,scientificName:string,canonicalName:string>").filter("d.scientificName IS NOT NULL")
        frames.append(rows.select(
            F.lit("gbif").alias("source"), F.col("d.key").alias("id"), F.coalesce("d.canonicalName", "d.scientificName").alias("title"),
            F.concat(F.lit("https://www.gbif.org/species/"), "d.key").alias("href"),
        ))
    return _union(frames)


def read_taxa(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return parse_taxa({s: raw_lines(spark, path) for s, path in paths.items()})


# --- authorities and the curated graph -------------------------------------------

PREF, ALT = "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel"


def parse_authority_labels(raw: DataFrame) -> DataFrame:
    """Heading and variants of an authority, in order. ``raw`` rows carry the
    authority's ``id``; its prefix tells which branch the node is under."""
    value = "array<string>"
    nodes = F.from_json("raw", f"array<struct<`@id`:string,`{PREF}`:{value},`{ALT}`:{value}>>")
    branch = F.when(F.col("id").rlike("^(sh|sj|gf)"), "subjects").otherwise("names")
    uri = F.concat(F.lit("http://id.loc.gov/authorities/"), branch, F.lit("/"), "id")
    node = F.get(F.filter(nodes, lambda n: n["@id"] == uri), F.lit(0))

    def text(v: Column) -> Column:
        return F.when(F.ltrim(v).startswith("{"), F.get_json_object(v, "$['@value']")).otherwise(v)

    heading = text(F.get(F.col("n")[PREF], F.lit(0)))
    variants = F.transform(F.coalesce(F.col("n")[ALT], F.array().cast(value)), text)
    forms = F.array_compact(F.concat(F.array(F.col("heading")), F.filter(F.col("variants"), lambda v: v != "")))
    return (
        raw.select("id", node.alias("n"))
        .withColumn("heading", heading)
        .withColumn("variants", variants)
        .filter("heading IS NOT NULL AND heading <> ''")
        .select("id", F.posexplode(forms).alias("_pos", "form"))
        .select("id", "form", F.when(F.col("_pos") == 0, "heading").otherwise("variant").alias("kind"), F.col("_pos").cast("bigint").alias("ord"))
    )


def read_authority_labels(spark: SparkSession, path: str) -> DataFrame:
    files = raw_files(spark, path)
    return parse_authority_labels(files.withColumn("id", F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)))


def parse_curated_graph(items: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items, and one directed edge per connection with its authorities."""
    schema = "struct<id:string,source:string,title:string,url:string,thumbnail:string,identifiers:map<string,string>,potential:map<string,bigint>>"
    nodes = _parsed(items, schema).filter("d.id IS NOT NULL").select(
        "d.id", "d.source", "d.title", "d.url", "d.thumbnail",
        F.try_element_at("d.identifiers", F.lit("wikidata")).alias("qid"),
        F.try_element_at("d.potential", F.lit("total")).alias("potential"),
    )
    # Of items that share an id, the least row stands.
    rest = [c for c in nodes.columns if c != "id"]
    nodes = nodes.groupBy("id").agg(F.min(F.struct(*rest)).alias("_n")).select("id", "_n.*")
    edge = "array<struct<targetId:string,type:string,label:string,linkedVia:array<string>>>"
    if "raw" in connections.columns:  # whole documents
        lists = connections.select(F.explode(F.from_json("raw", f"map<string,{edge}>")).alias("src", "out"))
    else:  # entries of one
        lists = connections.select(F.col("key").alias("src"), F.from_json("value", edge).alias("out"))
    edges = (
        lists.select("src", F.explode("out").alias("e"))
        .select(
            "src", F.col("e.targetId").alias("dst"), "e.type", "e.label",
            F.coalesce("e.linkedVia", F.array().cast("array<string>")).alias("linked_via"),
        )
    )
    return nodes, edges


def read_curated_graph(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """The graph of a folder. Its one large file, the connections, is read in ranges of ``split_bytes``."""
    spark.dataSource.register(JsonMap)
    items = raw_files(spark, f"{folder}/items/*.json").unionByName(raw_files(spark, f"{folder}/seed.json"))
    connections = spark.read.format("json_map").option("splitBytes", split_bytes).load(f"{folder}/connections.json")
    return parse_curated_graph(items, connections)
