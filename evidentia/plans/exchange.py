"""Queries of the sources and sinks: tables go out in an exchange format and come back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import annotation as A
from evidentia.operators import graph as G
from evidentia.plans.registry import query, r6, table
from evidentia.scratch import scratch_path
from evidentia.sources import readers as R
from evidentia.sources import writers as K
from evidentia.streaming import ingest


def _lines(df, spark, name: str) -> str:
    """One text file of the lines in their order."""
    path = scratch_path(spark, name)
    df.orderBy("o").select("line").coalesce(1).write.text(path)
    return path


@query("x AS (SELECT 1) SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey FROM nation")
def tsv_round_trip(spark, sf):
    K.tsv(table(spark, sf, "nation"), path := scratch_path(spark, "nation"))
    return R.tsv(spark, path, "n_nationkey string, n_name string, n_regionkey int")


@query("e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT DISTINCT bait, prey FROM (SELECT a::VARCHAR AS bait, b::VARCHAR AS prey FROM e UNION ALL SELECT b::VARCHAR, a::VARCHAR FROM e)")
def headerless_pairs(spark, sf):
    """Space-separated pairs without a header, in both orders."""
    K.text(table(spark, sf, "lineitem").select(F.concat_ws(" ", "l_suppkey", "l_partkey").alias("line")), path := scratch_path(spark, "pairs"))
    return A.symmetrised(R.tsv(spark, path, ["bait", "prey"], header=False, sep=" "), "bait", "prey")


@query("x AS (SELECT 1) SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 25")
def pushed_count(spark, sf):
    return R.parquet(spark, f"{sf}/lineitem.parquet", ["l_quantity"], "l_quantity > 25").agg(F.count("*").alias("n"))


@query("""r AS (SELECT 'S' || l_suppkey AS a, 'P' || l_partkey AS b, l_linestatus = 'O' AS x, l_returnflag = 'R' AS y, strftime(l_shipdate, '%Y%m') AS study, 'MI-000' || l_linenumber AS method FROM lineitem WHERE l_suppkey % 7 <> 0)
 SELECT DISTINCT CASE WHEN x THEN a ELSE b END AS bait, CASE WHEN x THEN b ELSE a END AS prey, study, method FROM r WHERE x <> y""")
def mitab_records(spark, sf):
    line = table(spark, sf, "lineitem")
    role = lambda on: F.when(on, 'psi-mi:"MI:0496"(bait)').otherwise('psi-mi:"MI:0498"(prey)')
    made = {
        "id_a": F.concat(F.lit("uniprotkb:S"), "l_suppkey"), "id_b": F.concat(F.lit("uniprotkb:P"), "l_partkey"), "method": F.concat(F.lit('psi-mi:"MI:000'), "l_linenumber", F.lit('"(x)')),
        "publication": F.concat(F.lit("imex:IM-1|pubmed:"), F.date_format("l_shipdate", "yyyyMM")), "taxon_a": F.when(F.col("l_suppkey") % 7 != 0, "taxid:9606(human)").otherwise("taxid:10090(mouse)"), "taxon_b": F.lit("taxid:9606(human)"),
        "role_a": role(F.col("l_linestatus") == "O"), "role_b": role(F.col("l_returnflag") == "R"),
    }
    K.tsv(line.select(*[made.get(c, F.lit("-")).alias(c) for c in R.MITAB]), path := scratch_path(spark, "mitab"))
    return R.mitab(spark, path)


@query("""x AS (SELECT o_custkey::VARCHAR AS id, arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS g, arg_min(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders WHERE o_custkey % 2 = 1 AND o_orderstatus IN ('F', 'O') GROUP BY 1)
 SELECT id, 'g' || g AS gene_id, 'n' || n AS gene_name FROM x""")
def id_mapping(spark, sf):
    """The last gene id and the first name of wanted ids; lines of another width are no data."""
    kind = F.when(F.col("o_orderstatus") == "F", F.concat_ws("\t", "o_custkey", F.lit("GeneID"), F.concat(F.lit("g"), "o_orderkey"))).when(F.col("o_orderstatus") == "O", F.concat_ws("\t", "o_custkey", F.lit("Gene_Name"), F.concat(F.lit("n"), "o_orderkey"))).otherwise(F.concat_ws("\t", "o_custkey", F.lit("broken")))
    path = _lines(table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), kind.alias("line")), spark, "idmapping")
    wanted = table(spark, sf, "customer").filter("c_custkey % 2 = 1").select(F.col("c_custkey").cast("string").alias("id"))
    return R.id_lookup(spark, path, wanted)


@query("""n AS (SELECT 'S' || p_size AS name, p_partkey AS g, 0 AS r FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')), p_partkey, 1 FROM part WHERE p_size % 5 <> 0)
 SELECT name, arg_min(g, (r, g))::VARCHAR AS gene_id FROM n GROUP BY name""")
def gene_synonyms(spark, sf):
    p = table(spark, sf, "part")
    line = F.concat_ws("\t", F.lit("9606"), "p_partkey", F.concat(F.lit("S"), "p_size"), F.lit("-"), F.when(F.col("p_size") % 5 != 0, F.replace("p_name", F.lit(" "), F.lit("|"))).otherwise("-"))
    path = _lines(p.select((F.col("p_partkey") + 1).alias("o"), line.alias("line")).unionByName(spark.createDataFrame([(0, "#tax_id\tGeneID\tSymbol")], "o long, line string")), spark, "genes")
    return R.gene_synonyms(spark, path)


@query("x AS (SELECT 1) SELECT 'P' || s_suppkey % 10 || 'AB' || s_suppkey % 7 || (s_suppkey % 9) AS secondary, 'Q' || (s_suppkey % 8) || 'CD' || s_suppkey % 5 || (s_suppkey % 3) AS primary FROM supplier WHERE s_suppkey % 2 = 0")
def secondary_accessions(spark, sf):
    m = lambda k: F.col("s_suppkey") % k
    line = F.concat(F.lit("P"), m(10), F.lit("AB"), m(7), m(9), F.lit("     Q"), m(8), F.lit("CD"), m(5), m(3))
    odd = F.when(m(2) == 0, line).when(m(3) == 0, F.lower(line)).otherwise(F.concat(line, F.lit(" x")))
    path = _lines(table(spark, sf, "supplier").select((F.col("s_suppkey") + 9).alias("o"), odd.alias("line")).unionByName(spark.createDataFrame([(0, "Secondary AC list"), (1, "_____ _____")], "o long, line string")), spark, "secondary")
    return R.secondary_accessions(spark, path)


@query("x AS (SELECT 1) SELECT 'S' || s_suppkey AS id, s_name AS seq, length(s_name)::INT AS n FROM supplier WHERE s_suppkey % 3 = 0")
def fasta_round_trip(spark, sf):
    """Sequences out and back, held to the ids of another file."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("sp|S"), "s_suppkey", F.lit("|X GN="), "s_suppkey").alias("id"), F.col("s_name").alias("seq"))
    K.fasta(s, path := scratch_path(spark, "fasta"))
    K.fasta(s.filter("s_suppkey % 3 = 0"), some := scratch_path(spark, "fasta"))
    return R.fasta(spark, path).join(R.fasta_ids(spark, some), "id", "left_semi").select("id", "seq", F.length("seq").alias("n"))


@query("x AS (SELECT 1) SELECT 'CVCL_' || n_nationkey AS AC, 'NCBI_TaxID=' || CASE WHEN n_regionkey < 3 THEN '9606' ELSE '10090' END || CASE WHEN n_regionkey = 1 THEN '<->NCBI_TaxID=1' ELSE '' END AS OX FROM nation WHERE n_regionkey < 3")
def cell_records(spark, sf):
    """Multi-line records of human cell lines; a repeated code is joined."""
    ox = F.concat(F.lit("OX   NCBI_TaxID="), F.when(F.col("n_regionkey") < 3, "9606").otherwise("10090"), F.when(F.col("n_regionkey") == 1, "\nOX   NCBI_TaxID=1").otherwise(""))
    K.text(table(spark, sf, "nation").select(F.concat(F.lit("ID   x\nAC   CVCL_"), "n_nationkey", F.lit("\n"), ox, F.lit("\n//")).alias("line")), path := scratch_path(spark, "records"))
    return R.records(spark, path, ["AC", "OX"]).filter(F.col("OX").contains("9606"))


@query("e AS (SELECT p_partkey::VARCHAR AS gene, trim(unnest(string_split(p_name, ' '))) AS location FROM part WHERE p_type IN ('SMALL', 'PROMO')), k AS (SELECT location FROM e GROUP BY 1 HAVING count(DISTINCT gene) > 2) SELECT gene, location FROM e JOIN k USING (location)")
def localisation_list(spark, sf):
    """A list column of reliable rows, without rare locations."""
    K.tsv(table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("reliability"), F.replace("p_name", F.lit(" "), F.lit("; ")).alias("location")), path := scratch_path(spark, "localisation"))
    e = R.listed(R.tsv(spark, path, ["gene", "reliability", "location"]), "location", ";", F.col("reliability").isin("SMALL", "PROMO")).select("gene", "location")
    return e.join(e.groupBy("location").agg(F.count_distinct("gene").alias("n")).filter("n > 2").select("location"), "location", "left_semi")


@query("x AS (SELECT 1) SELECT vec_id::VARCHAR AS id, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 3) + 0.0 AS total FROM embeddings")
def vectors_round_trip(spark, sf):
    v = table(spark, sf, "embeddings")
    K.text(v.select(F.concat_ws("\t", F.col("embedding").cast("array<string>"), F.col("vec_id").cast("string")).alias("line")), path := scratch_path(spark, "vectors"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return R.vectors(spark, path).select("id", F.size("vector").alias("width"), (F.round(total, 3) + 0.0).alias("total"))


@query("""h AS (SELECT 'g' || l_suppkey AS q, 'g' || l_partkey % 50 AS s, l_quantity AS b, l_orderkey * 10 + l_linenumber AS o, l_partkey AS p FROM lineitem), n AS (SELECT 'g' || p_partkey AS gene, p_size + 5 AS length FROM part),
 w AS (SELECT least(q, s) AS a, greatest(q, s) AS c, o, p, b / least(x.length, y.length) * (SELECT round_even(avg(length), 0) FROM n) AS v FROM h JOIN n x ON x.gene = q JOIN n y ON y.gene = s WHERE q <> s)
 SELECT a, c AS b, round_even(arg_min(v, (o, p)), 0) AS weight FROM w GROUP BY 1, 2""")
def similarity_edges(spark, sf):
    """Hits out as a table, back with their line numbers, and as one edge per pair of sequences."""
    line = table(spark, sf, "lineitem")
    text = F.concat_ws("\t", F.concat(F.lit("g"), "l_suppkey"), F.concat(F.lit("g"), F.col("l_partkey") % 50, F.lit(" a title")), F.lit("1e-5"), "l_quantity")
    path = _lines(line.select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_partkey").alias("o"), text.alias("line")), spark, "hits")
    lengths = table(spark, sf, "part").select(F.concat(F.lit("g"), "p_partkey").alias("gene"), (F.col("p_size") + 5).alias("length"))
    return G.similarity_edges(R.similarity_hits(spark, path), lengths)


@query("x AS (SELECT 1) SELECT 'S' || s_suppkey AS id, (s_suppkey % 60 + 40)::DOUBLE AS identity FROM supplier WHERE s_suppkey % 4 <> 0")
def cluster_members(spark, sf):
    at = F.when(F.col("s_suppkey") % 4 == 0, "*").otherwise(F.concat(F.lit("at "), F.col("s_suppkey") % 60 + 40, F.lit("%")))
    K.text(table(spark, sf, "supplier").select(F.concat(F.lit("0\t120aa, >S"), "s_suppkey", F.lit("... "), at).alias("line")), path := scratch_path(spark, "clusters"))
    return R.clusters(spark, path)


@query("x AS (SELECT 1) SELECT row_number() OVER (ORDER BY c_custkey) AS node_id, c_name AS value FROM customer")
def numbered_lines(spark, sf):
    return R.numbered_lines(spark, _lines(table(spark, sf, "customer").select(F.col("c_custkey").alias("o"), F.col("c_name").alias("line")), spark, "lines"))


@query("x AS (SELECT 1) SELECT 'P' || s_suppkey AS id, 'P' || s_suppkey || '-' || (s_suppkey % 2 + 1) AS isoform FROM supplier WHERE s_suppkey % 3 <> 0")
def displayed_isoforms(spark, sf):
    one = lambda k, st: F.struct(F.array(F.concat(F.lit("P"), "s_suppkey", F.lit(f"-{k}"))).alias("isoformIds"), F.when(st, "Displayed").otherwise("External").alias("isoformSequenceStatus"))
    even = F.col("s_suppkey") % 2 == 0
    comment = F.struct(F.when(F.col("s_suppkey") % 3 != 0, "ALTERNATIVE PRODUCTS").otherwise("FUNCTION").alias("commentType"), F.array(one(1, even), one(2, ~even)).alias("isoforms"))
    K.text(table(spark, sf, "supplier").select(F.to_json(F.struct(F.concat(F.lit("P"), "s_suppkey").alias("primaryAccession"), F.array(comment).alias("comments"))).alias("line")), path := scratch_path(spark, "isoforms"))
    return R.displayed_isoforms(spark, path)


@query("""p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT 'p' || k AS id, round(CASE WHEN k % 3 = 0 THEN s / 100.0 WHEN k % 3 = 1 THEN least(1.0, (s + 1 + 10) / 50.0) END, 6) AS disorder_fraction,
 CASE WHEN k % 3 = 0 THEN 'service' WHEN k % 3 = 1 THEN 'regions' ELSE 'none' END AS disorder_fraction_source FROM p""")
def disorder_fallback(spark, sf):
    """Disorder of a service's answer, else of annotated regions, else none."""
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_partkey", "p_size")
    value = F.when(F.col("p_partkey") % 3 == 0, F.struct((F.col("p_size") / 100.0).alias("content_fraction")))
    K.text(p.select(F.to_json(F.struct(F.col("id").alias("acc"), value.alias("prediction-disorder-mobidb_lite"))).alias("line")), path := scratch_path(spark, "disorder"))
    note = F.concat(F.lit('REGION 1..'), (F.col("p_size") + 1), F.lit('; /note="Disordered"; REGION 90..99; /note="Disordered"; REGION 5..80; /note="Other"'))
    regions = p.select("id", A.region_fraction(F.when(F.col("p_partkey") % 3 == 1, note), F.lit(50)).alias("disorder_fraction"))
    return A.with_fallback(p.select("id"), "id", "disorder_fraction", [("service", R.disorder(spark, path)), ("regions", regions)]).withColumn("disorder_fraction", r6("disorder_fraction"))


@query("""x AS (SELECT p_partkey AS k, p_size AS s, p_type AS t FROM part) SELECT k::VARCHAR AS uniprot_id, s % 4 <> 0 AS enzyme, s % 4 = 1 AND k % 2 = 0 AS narrow_substrate_enzyme, t = 'SMALL' AS membrane, t = 'PROMO' OR t = 'MEDIUM' AS secreted, (s % 3 + 1)::INT AS n_pubmed FROM x""")
def protein_features(spark, sf):
    m = lambda k: F.col("p_size") % k
    made = {
        "Entry": F.col("p_partkey"), "Length": F.col("p_size"), "Transmembrane": F.when(F.col("p_type") == "SMALL", "TRANSMEM 1..9").otherwise(" "), "Subcellular location [CC]": F.when(F.col("p_type") == "PROMO", "SUBCELLULAR LOCATION: Secreted").otherwise("Nucleus"),
        "EC number": F.when(m(4) == 0, "").when(m(4) == 1, "1.2.3.4").when(m(4) == 2, "1.2.3.-").otherwise("1.2.3.4; 2.3.4.5"), "Signal peptide": F.when(F.col("p_type") == "MEDIUM", "SIGNAL 1..20").otherwise(""),
        "Catalytic activity": F.when(F.col("p_partkey") % 2 == 0, "CATALYTIC ACTIVITY: a").otherwise("CATALYTIC ACTIVITY: a CATALYTIC ACTIVITY: b"), "Region": F.lit(""), "PubMed ID": F.concat_ws("; ", F.array_repeat(F.lit("7"), 2), F.when(m(3) > 0, "8"), F.when(m(3) > 1, "9")),
    }
    K.tsv(table(spark, sf, "part").select(*[c.cast("string").alias(k) for k, c in made.items()]), path := scratch_path(spark, "annotation"))
    out = A.derived_features(R.annotation_dump(spark, path))
    return out.select("uniprot_id", "enzyme", "narrow_substrate_enzyme", "membrane", "secreted", A.list_size(F.col("lit_pubmed_id")).alias("n_pubmed"))


@query("x AS (SELECT lower(l_returnflag) AS dataset, l_suppkey AS bait, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT dataset, count(*)::BIGINT AS files_rows, sum(n)::BIGINT AS n FROM x GROUP BY 1")
def tagged_files(spark, sf):
    """Files of several data sets as one table; the tag comes from the name."""
    line, paths = table(spark, sf, "lineitem"), []
    for m in "ANR":
        paths.append(f"{scratch_path(spark, 'set')}/{m.lower()}_degree.tsv")
        K.tsv(line.filter(F.col("l_returnflag") == m).groupBy(F.col("l_suppkey").alias("bait")).agg(F.count("*").alias("n")), paths[-1])
    return R.tagged(spark, paths, "bait long, n long", r"/([a-z]+)_degree\.tsv").groupBy("dataset").agg(F.count("*").alias("files_rows"), F.sum("n").alias("n"))


@query("x AS (SELECT 1) SELECT 'm' || l_linenumber AS model, round(avg(l_discount), 6) AS roc_auc, count(*)::DOUBLE AS samples FROM lineitem WHERE l_linenumber < 4 GROUP BY l_linenumber")
def metric_files(spark, sf):
    """A report per model, read back and collated."""
    line, paths = table(spark, sf, "lineitem"), []
    for k in (1, 2, 3):
        paths.append(f"{scratch_path(spark, 'metrics')}/m{k}_metrics.txt")
        K.report(line.filter(F.col("l_linenumber") == k).agg(F.avg("l_discount").alias("roc_auc"), F.count("*").alias("samples")), paths[-1])
    kv = R.key_values(spark, paths, r"/([^/]+)_metrics\.txt")
    wide = kv.groupBy("model").pivot("key", ["roc_auc", "samples"]).agg(F.first("value"))
    return wide.withColumn("roc_auc", r6("roc_auc"))


@query("""e AS (SELECT DISTINCT l_suppkey AS bait, l_orderkey AS study FROM lineitem WHERE l_orderkey NOT IN (1, 2)), t AS (SELECT o_orderkey AS study, CASE WHEN o_orderkey % 4 <> 0 THEN c_mktsegment END AS cvcl FROM orders JOIN customer ON o_custkey = c_custkey),
 j AS (SELECT bait, e.study, CASE WHEN e.study % 5 = 0 THEN 'CURATED' ELSE cvcl END AS cvcl FROM e LEFT JOIN t ON t.study = e.study) SELECT bait, study::VARCHAR AS study, cvcl FROM j WHERE cvcl IS NOT NULL""")
def cell_annotation(spark, sf):
    """Studies get the curated cell line, or the one they are tagged with if it is the only one; two studies are left out."""
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("bait"), F.col("l_orderkey").cast("string").alias("study")).distinct()
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("cvcl"))
    tagged = o.unionByName(o.filter("k % 4 = 0").withColumn("cvcl", F.lit("SECOND"))).select(F.col("k").cast("string").alias("study"), "cvcl")
    K.tsv(o.select(F.col("k").alias("pubmed_id"), F.lit("3").alias("size"), F.when(F.col("k") % 5 == 0, "CURATED").otherwise("").alias("cl_id"), F.lit("").alias("Comment"), F.lit("").alias("Intact?")), path := scratch_path(spark, "curated"))
    return A.with_cell_lines(e, tagged, R.curated_studies(spark, path), ["1", "2"]).select("bait", "study", "cvcl")


@query("x AS (SELECT 1) SELECT l_returnflag AS method, l_linestatus AS kind, count(*)::BIGINT AS n, sum(l_suppkey)::BIGINT AS s FROM lineitem GROUP BY ALL")
def partitioned_parquet(spark, sf):
    """A folder per method and kind, read as one table."""
    K.parquet(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("kind")), path := scratch_path(spark, "parts"), ["method", "kind"])
    return R.parquet(spark, path).groupBy("method", "kind").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("s"))


@query("""e AS (SELECT DISTINCT least(s_nationkey, c_nationkey) + 1 AS a, greatest(s_nationkey, c_nationkey) + 1 AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey),
 d AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e), n AS (SELECT unnest(range(1, (SELECT max(v) + 1 FROM d))) AS v), l AS (SELECT n.v, coalesce(string_agg(w::VARCHAR || ' 1', ' ' ORDER BY w), '') AS value FROM n LEFT JOIN d ON d.v = n.v GROUP BY 1)
 SELECT 1::BIGINT AS node_id, (SELECT max(v) FROM d)::VARCHAR || ' ' || (SELECT count(*) FROM e)::VARCHAR || ' 1' AS value UNION ALL SELECT v + 1, value FROM l""")
def metis_document(spark, sf):
    """The adjacency lines and their header, numbered as a reader of the joined files would."""
    K.metis(_nation_edges(spark, sf).withColumn("weight", F.lit(1)), path := scratch_path(spark, "metis"))
    return R.numbered_lines(spark, path)


def _nation_edges(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = line.filter("s_nationkey <> c_nationkey").select((F.least("s_nationkey", "c_nationkey") + 1).alias("a"), (F.greatest("s_nationkey", "c_nationkey") + 1).alias("b"))
    return e.distinct()


@query("""e AS (SELECT DISTINCT least(s_nationkey, c_nationkey) + 1 AS a, greatest(s_nationkey, c_nationkey) + 1 AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)
 SELECT 'edge' AS kind, count(*)::BIGINT AS n, true AS between FROM e UNION ALL SELECT 'node', (SELECT count(DISTINCT v) FROM (SELECT a AS v FROM e UNION SELECT b FROM e)), true UNION ALL SELECT 'graphml', 1, false UNION ALL SELECT '/graph', 1, false""")
def graphml_document(spark, sf):
    """Elements of the document by kind, and whether they lie between its first and last line."""
    K.graphml(_nation_edges(spark, sf), path := scratch_path(spark, "graphml"))
    lines = R.numbered_lines(spark, path).withColumn("kind", F.regexp_extract("value", "^<(/?[a-z]+)", 1))
    ends = lines.agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    inside = (F.col("node_id") > F.col("lo")) & (F.col("node_id") < F.col("hi"))
    return lines.crossJoin(F.broadcast(ends)).groupBy("kind").agg(F.count("*").alias("n"), F.bool_and(inside).alias("between"))  # one row


@query("x AS (SELECT c_nationkey AS i, c_custkey % 25 AS j, avg(c_acctbal) AS r FROM customer GROUP BY ALL) SELECT key, value FROM (SELECT 'cells' AS key, count(*)::VARCHAR AS value FROM x UNION ALL SELECT 'index', '25' UNION ALL SELECT 'source', 'customers')")
def matrix_files(spark, sf):
    cells = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 25).alias("j")).agg(F.avg("c_acctbal").alias("r"))
    K.matrix(cells, table(spark, sf, "nation").select("n_name", "n_nationkey"), path := scratch_path(spark, "matrix"), source="customers")
    sizes = R.parquet(spark, f"{path}/cells").agg(F.lit("cells").alias("key"), F.count("*").cast("string").alias("value")).unionByName(R.tsv(spark, f"{path}/index", ["n_name", "n_nationkey"]).agg(F.lit("index").alias("key"), F.count("*").cast("string").alias("value")))
    return sizes.unionByName(R.tsv(spark, f"{path}/about", ["key", "value"]))


@query("x AS (SELECT 1) SELECT event_type, user_id, count(*)::BIGINT AS n_observed FROM events GROUP BY ALL")
def stream_counts(spark, sf):
    """Observations of pairs over a stream of the events, every epoch in a folder of its own; the last holds them all."""
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts, path = ingest.observed_counts(events, ["event_type", "user_id"]), scratch_path(spark, "epochs")
    sink = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream")).foreachBatch(lambda batch, epoch: ingest.append_new(batch, epoch, path))
    sink.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    return rows.join(rows.agg(F.max("epoch").alias("epoch")), "epoch").drop("epoch")
