import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from tallytree.session import pin, scratch_path
from tallytree.sources import instance, listings, pieces, sinks, taxonomy
from tallytree.star import Star
from tallytree.streaming import refresh

from conftest import rows


def in_order(df, seq, *columns):
    """Rows by their order key, as numbers from 1; no two share a key."""
    picked = df.select(seq, *columns).orderBy(seq).collect()
    assert len({r[0] for r in picked}) == len(picked)
    return [(i, *r[1:]) for i, r in enumerate(picked, 1)]


INSTANCE = """<?xml version="1.0"?>
<xbrli:xbrl xmlns:xbrli="x" xmlns:us-gaap="g" xmlns:xbrldi="d">
  <link:schemaRef xlink:href="w.xsd"/>
  <xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="s">1</xbrli:identifier></xbrli:entity>
    <xbrli:period><xbrli:instant>2019-12-31</xbrli:instant></xbrli:period></xbrli:context>
  <xbrli:context id="c2"><xbrli:entity><xbrli:identifier scheme="s">1</xbrli:identifier><xbrli:segment>
    <xbrldi:explicitMember dimension="srt:ProductAxis">w:OilMember</xbrldi:explicitMember>
    <xbrldi:explicitMember dimension="dei:LegalAxis">w:SubMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
    <xbrli:period><xbrli:startDate>2019-01-01</xbrli:startDate><xbrli:endDate>2019-12-31</xbrli:endDate></xbrli:period></xbrli:context>
  <us-gaap:Assets contextRef="c1" unitRef="u" decimals="-3" id="f1">1000</us-gaap:Assets>
  <us-gaap:Nothing contextRef="c1" xsi:nil="true"/><w:Note contextRef="c2" id="f2">a &lt;b&gt; &amp;lt; c
second line</w:Note>
  <us-gaap:Rate contextRef='c2' decimals='INF'>0.5</us-gaap:Rate>
</xbrli:xbrl>"""
PRE = """<link:linkbase><link:presentationLink xlink:type="extended" xlink:role="http://r/bs">
  <link:loc xlink:href="w.xsd#us-gaap_Abs" xlink:label="l1"/><link:loc xlink:href="g.xsd#us-gaap_Assets" xlink:label="l2"/>
  <link:presentationArc xlink:from="l1" xlink:to="l2" order="1.0" preferredLabel="http://p" xlink:arcrole="http://a/parent-child"/>
</link:presentationLink><link:presentationLink xlink:role="http://r/is">
  <link:loc xlink:href="w.xsd#w_Abs" xlink:label="l1"/><link:loc xlink:href="g.xsd#w_X" xlink:label="l2"/>
  <link:presentationArc xlink:from="l1" xlink:to="l2" order="2"/></link:presentationLink></link:linkbase>"""
CAL = """<linkbase><calculationLink xlink:role="http://r/bs">
  <loc xlink:href="w.xsd#us-gaap_Assets" xlink:label="l1"/><loc xlink:href="g.xsd#us-gaap_Cash" xlink:label="l2"/>
  <calculationArc xlink:from="l1" xlink:to="l2" order="1" weight="1" xlink:arcrole="http://www.xbrl.org/2003/arcrole/summation-item"/>
</calculationLink></linkbase>"""
LAB = """<link:linkbase><link:labelLink xlink:role="r">
  <link:loc xlink:href="g.xsd#us-gaap_Assets" xlink:label="a"/>
  <link:label xlink:label="t" xlink:role="http://www.xbrl.org/2003/role/label" xml:lang="en-US">Assets</link:label>
  <link:label xlink:label="t2" xlink:role="http://www.xbrl.org/2003/role/totalLabel" xml:lang="en-US">Total assets</link:label>
  <link:labelArc xlink:from="a" xlink:to="t"/><link:labelArc xlink:from="a" xlink:to="t2"/></link:labelLink></link:linkbase>"""
XSD = """<xsd:schema xmlns:xsd="x"><xsd:annotation><xsd:appinfo>
  <link:roleType roleURI="http://r/bs" id="bs"><link:definition>00100 - Statement - BALANCE - SHEETS</link:definition>
    <link:usedOn>link:presentationLink</link:usedOn><link:usedOn>link:calculationLink</link:usedOn></link:roleType>
  <link:linkbaseRef xlink:href="w_pre.xml" xlink:role="http://x/presentationLinkbaseRef"/></xsd:appinfo></xsd:annotation>
  <xsd:import namespace="http://n" schemaLocation="n.xsd"/>
  <xsd:element id='w_X' name='X' type='xbrli:monetaryItemType' nillable='true' xbrli:balance='credit' xbrli:periodType="instant"/>
  <element name="DE" id="country_DE" type="nonnum:domainItemType" abstract="true"/>
  <xsd:simpleType><xsd:restriction><xsd:enumeration value="10-K"/><xsd:enumeration value="10-Q"/></xsd:restriction></xsd:simpleType>
</xsd:schema>"""


def write(folder, **parts):
    os.makedirs(folder, exist_ok=True)
    for name, text in parts.items():
        base, _, end = name.rpartition("_")
        with open(os.path.join(folder, f"{base}.{end}"), "w") as out:
            out.write(text)


def filings(tmp_path):
    for number in ("7", "12"):
        write(str(tmp_path / number), w_ins_xml=INSTANCE, w_pre_xml=PRE, w_cal_xml=CAL, w_lab_xml=LAB, w_xsd=XSD)
    return str(tmp_path)


def test_load_filings(spark, tmp_path):
    star = instance.load_filings(spark, filings(tmp_path))
    star.write(str(tmp_path / "star"))
    star = Star.read(spark, str(tmp_path / "star"))
    assert in_order(star.fact.filter("filing_id = 7"), "fact_seq", "element_id", "context_id", "fact", "decimals") == [
        (1, "us-gaap_Assets", "c1", "1000", "-3"),
        (2, "us-gaap_Nothing", "c1", None, None),
        (3, "w_Note", "c2", "a <b> &lt; c\nsecond line", None),
        (4, "us-gaap_Rate", "c2", "0.5", "INF"),
    ]
    end = dt.date(2019, 12, 31)
    assert rows(star.context.filter("filing_id = 12").drop("filing_id")) == [
        ("c1", None, end, None, None, None),
        ("c2", dt.date(2019, 1, 1), end, "srt:ProductAxis", "w:OilMember", "dei:LegalAxis"),
    ]
    assert in_order(star.presentation.filter("filing_id = 7"), "arc_seq", "role_id", "from_element_id", "to_element_id", "arc_order", "preferred_label") == [
        (1, "http://r/bs", "us-gaap_Abs", "us-gaap_Assets", "1.0", "http://p"),
        (2, "http://r/is", "w_Abs", "w_X", "2", None),
    ]
    assert rows(star.calculation, "filing_id", "from_element_id", "to_element_id", "arcrole") == [
        (12, "us-gaap_Assets", "us-gaap_Cash", "summation-item"), (7, "us-gaap_Assets", "us-gaap_Cash", "summation-item")]
    assert in_order(star.label.filter("filing_id = 7"), "label_seq", "element_id", "label_string") == [
        (1, "us-gaap_Assets", "Assets"), (2, "us-gaap_Assets", "Total assets")]
    assert rows(star.role, "filing_id", "type", "description") == [
        (12, "Statement", "BALANCE - SHEETS"), (7, "Statement", "BALANCE - SHEETS")]
    assert ("w_X", "credit") in rows(star.element, "element_id", "balance")


ODD_INSTANCE = """<?xml version="1.0"?>
<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:us-gaap="g"><!-- <us-gaap:Old contextRef="c1">0</us-gaap:Old> -->
  <context id="c1"><entity><identifier scheme="s">1</identifier><segment>
    <typedMember dimension="w:WellAxis"><w:well>Nr. 5 &amp; 6</w:well></typedMember></segment></entity>
    <period><instant>2019-12-31</instant></period></context>
  <context id="c2"><entity><identifier scheme="s">1</identifier><segment>
    <explicitMember dimension="srt:ProductAxis">w:OilMember</explicitMember></segment></entity>
    <period><instant>2019-12-31</instant></period>
    <scenario><explicitMember dimension="w:PlanAxis">w:HighMember</explicitMember></scenario></context>
  <Assets contextRef="c1" decimals="0">12</Assets>
  <us-gaap:Note contextRef="c1" id="a&gt;b" title='x > "y"'><![CDATA[<p class="c">1 &amp; 2</p><b>x</b>]]> end</us-gaap:Note>
  <us-gaap:Text contextRef="c1">caf&#233;&#160;&lt;b&gt;</us-gaap:Text>
  <us-gaap:Empty contextRef="c1"></us-gaap:Empty><us-gaap:Gone contextRef="c1" nil="true"/>
</xbrl>"""
SHARED_PRE = """<link:linkbase><link:presentationLink xlink:role="http://r/bs">
  <link:loc xlink:href="w.xsd#w_Top" xlink:label="top"/><link:loc xlink:href="g.xsd#us-gaap_A" xlink:label="many"/>
  <link:loc xlink:href="g.xsd#us-gaap_B" xlink:label="many"/><link:loc xlink:href="g.xsd#us-gaap_B" xlink:label="many"/>
  <link:presentationArc xlink:from="top" xlink:to="many" order="1"/><link:presentationArc xlink:from="many" xlink:to="top" order="2"/>
</link:presentationLink></link:linkbase>"""


def odd_filings(tmp_path):
    write(str(tmp_path / "0001193125-19-000001"), **{"w-20191231_xml": ODD_INSTANCE, "w-20191231_pre_xml": SHARED_PRE, "w_xsd": XSD})
    return str(tmp_path)


def test_ordinary_documents(spark, tmp_path):
    """Names as filers use them, dashed folders, default namespace, CDATA, character numbers, comments, nil and empty."""
    star = instance.load_filings(spark, odd_filings(tmp_path))
    number = 119312519000001
    assert in_order(star.fact, "fact_seq", "filing_id", "element_id", "fact") == [
        (1, number, "Assets", "12"),
        (2, number, "us-gaap_Note", '<p class="c">1 &amp; 2</p><b>x</b> end'),
        (3, number, "us-gaap_Text", "caf\u00e9\u00a0<b>"),
        (4, number, "us-gaap_Empty", ""),
        (5, number, "us-gaap_Gone", None),
    ]
    assert rows(instance.read_facts(spark, str(tmp_path), default_prefix="us-gaap").orderBy("fact_seq").limit(1), "element_id") == [("us-gaap_Assets",)]
    assert rows(star.context, "context_id", "dimension1", "value1", "dimension2") == [
        ("c1", "w:WellAxis", "Nr. 5 & 6", None), ("c2", "srt:ProductAxis", "w:OilMember", "w:PlanAxis")]


def test_shared_locators_give_all_arcs(spark, tmp_path):
    arcs = instance.read_presentation(spark, odd_filings(tmp_path))
    assert in_order(arcs, "arc_seq", "from_element_id", "to_element_id") == [
        (1, "w_Top", "us-gaap_A"), (2, "w_Top", "us-gaap_B"), (3, "us-gaap_A", "w_Top"), (4, "us-gaap_B", "w_Top")]


SECTIONS = """<?xml version="1.0"?><!-- made by hand -->
<xbrl><us-gaap:A contextRef="c">1<!-- <us-gaap:Old contextRef="c">0</us-gaap:Old> -->2</us-gaap:A>
<us-gaap:B contextRef="c"><![CDATA[<!-- kept --><i contextRef="no">]]><![CDATA[x]]> y</us-gaap:B><?pi <a> ?>
<!-- <![CDATA[ --><us-gaap:C contextRef="c">3</us-gaap:C><!-- ]]> --><us-gaap:D contextRef="c">a &#38; b</us-gaap:D></xbrl>"""


def test_sections_are_read_in_order(spark, tmp_path):
    write(str(tmp_path / "5"), s_xml=SECTIONS)
    write(str(tmp_path / "6"), i_xml=INSTANCE)
    facts = instance.read_facts(spark, str(tmp_path))
    assert in_order(facts.filter("filing_id = 5"), "fact_seq", "element_id", "fact") == [
        (1, "us-gaap_A", "12"), (2, "us-gaap_B", '<!-- kept --><i contextRef="no">x y'), (3, "us-gaap_C", "3"), (4, "us-gaap_D", "a & b")]
    assert facts.filter("filing_id = 6").count() == 4


@pytest.mark.parametrize("sections", [False, True])
def test_a_large_document_is_read_by_many_tasks(spark, tmp_path, sections):
    """The same rows in the same order, however small the byte ranges."""
    lines = [f'<w:F{i % 7} contextRef="c{i}" decimals="{i % 3}">é {i} &lt;td&gt;{"x" * (i % 90)}</w:F{i % 7}>' for i in range(3000)]
    if sections:
        lines[::500] = [f"<![CDATA[<p {i}>]]>\n<!-- <w:Off contextRef='c'>1</w:Off> -->{line}" for i, line in enumerate(lines[::500])]
    write(str(tmp_path / "9"), big_xml="<?xml version='1.0'?>\n<xbrl>" + "\n".join(lines) + "</xbrl>", small_xml=INSTANCE)
    whole = in_order(instance.read_facts(spark, str(tmp_path)), "fact_seq", "context_id", "element_id", "fact", "decimals")
    assert len(whole) == 3004 and [r[1] for r in whole[:3000]] == [f"c{i}" for i in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert pieces.document_pieces(spark, str(tmp_path), "big.xml").rdd.getNumPartitions() > 10
        facts = instance.read_facts(spark, str(tmp_path))
        assert in_order(facts, "fact_seq", "context_id", "element_id", "fact", "decimals") == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_vanishes_silently(spark, tmp_path):
    write(str(tmp_path / "no-number"), w_ins_xml=INSTANCE)
    with pytest.raises(Exception, match="no filing number"):
        instance.read_facts(spark, str(tmp_path / "no-number")).collect()
    write(str(tmp_path / "all" / "7"), w_ins_xml=INSTANCE)
    write(str(tmp_path / "all" / "8"), w_pre_xml=PRE)
    with pytest.raises(instance.MissingInstance, match="8"):
        instance.load_filings(spark, str(tmp_path / "all"))


def test_elements_of_shared_taxonomies(spark, tmp_path):
    root, shared = tmp_path / "filings", tmp_path / "taxonomy"
    write(str(root / "7"), w_ins_xml=INSTANCE, w_pre_xml=PRE, w_cal_xml=CAL, w_xsd=XSD)
    write(str(shared), g_xsd=XSD.replace("w_X", "us-gaap_Assets"))
    star = instance.load_filings(spark, str(root), taxonomy=str(shared))
    assert {("us-gaap_Assets", "credit"), ("w_X", "credit")} <= set(rows(star.element, "element_id", "balance"))
    assert star.element.filter("element_id = 'us-gaap_Cash'").isEmpty()


def test_star_opens_the_folders_of_a_batch_only(spark, tmp_path):
    instance.load_filings(spark, filings(tmp_path / "docs")).write(str(tmp_path / "star"), buckets=64)
    batch = spark.createDataFrame([(7,)], "filing_id BIGINT")
    found = Star.read_filings(spark, str(tmp_path / "star"), batch)
    assert found.fact.count() == 4 and rows(found.role.select("filing_id").distinct()) == [(7,)]
    plan = found.fact._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*filing_bucket", plan)


def test_refresh_leaves_no_scratch_behind(spark, tmp_path):
    star = instance.load_filings(spark, filings(tmp_path / "docs"))
    star.write(str(tmp_path / "star"))
    folder = os.path.dirname(scratch_path(spark, "x").removeprefix("file:"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    arrivals, target = str(tmp_path / "arrivals"), str(tmp_path / "out")
    spark.createDataFrame([(7, dt.datetime(2024, 1, 1))], "filing_id BIGINT, arrived_at TIMESTAMP").write.parquet(arrivals)
    refresh.refresh_statements(
        spark, arrivals, str(tmp_path / "star"), target, str(tmp_path / "cp"),
        lambda s: pin(s.fact.groupBy("filing_id").agg(F.count("*").alias("n")), "x")).awaitTermination(120)
    assert rows(refresh.current_rows(spark, target), "filing_id", "n") == [(7, 4)]
    assert set(os.listdir(folder)) == before
    refresh.compact(spark, target, str(tmp_path / "compact"))
    assert rows(refresh.current_rows(spark, str(tmp_path / "compact")), "filing_id", "n") == [(7, 4)]


def test_taxonomy(spark, tmp_path):
    write(str(tmp_path), t_xsd=XSD)
    path = str(tmp_path)
    assert rows(taxonomy.scan_elements(spark, path), "element_id", "item_type", "abstract", "nillable", "period_type", "balance") == [
        ("country_DE", "domainItemType", True, False, None, None),
        ("w_X", "monetaryItemType", False, True, "instant", "credit")]
    assert rows(taxonomy.scan_members(spark, path), "name") == [("DE",)]
    assert rows(taxonomy.scan_enumerations(spark, path), "value") == [("10-K",), ("10-Q",)]
    role = taxonomy.scan_roles(spark, path).first()
    assert (role.code, role.type, role.title, len(role.used_on)) == ("00100", "Statement", "BALANCE - SHEETS", 2)
    assert rows(taxonomy.scan_links(spark, path), "kind", "target") == [("import", "n.xsd"), ("linkbase", "w_pre.xml")]


def test_listings(spark, tmp_path):
    csv = tmp_path / "prices.csv"
    csv.write_text("sym,Date,X.Open,X.High,X.Low,X.Close\nWLL,2019-01-02,1,3,0.5,2\n")
    prices = listings.read_prices(spark, str(csv))
    assert prices.columns == listings.PRICE_COLUMNS
    assert rows(prices) == [("WLL", dt.date(2019, 1, 2), 1.0, 3.0, 0.5, 2.0)]
    known = listings.known_companies(spark)
    assert known.count() == 49 and rows(listings.tickers_of(known, "Apache")) == [("APA",)]
    index = tmp_path / "index"
    index.mkdir()
    (index / "a.json").write_text('{"company_id":1,"filing_date":"2019-02-01","type":"10-K","href":"/a"}\n'
                                  '{"company_id":1,"filing_date":"2019-02-02","type":"8-K","href":"/b"}\n')
    assert rows(listings.read_filing_index(spark, str(index), "json", prefix="10-"), "href") == [("/a",)]
    assert rows(listings.read_newest_filings(spark, str(index), "json"), "href") == [("/a",)]


def test_write_statement(spark, tmp_path):
    lines = spark.createDataFrame(
        [("balance_sheet", 1, "Cash", "2019-12-31", 1.0), ("cash_flow", 1, "Paid", "3 months ended 2018-03-31", 2.0)],
        "statement STRING, filing_id BIGINT, label STRING, period STRING, value DOUBLE")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        sinks.write_statement(lines, path, fmt)
        assert os.path.isdir(f"{path}/statement=cash_flow/period_year=2018")
        back = spark.read.format(fmt).option("header", "true").load(path)
        assert rows(back, "statement", "label", "period") == rows(lines, "statement", "label", "period")


def test_tick_bars(spark, tmp_path):
    t = lambda s: dt.datetime.fromisoformat(s)
    ticks = [("A", t("2024-01-01T10:00:00"), 1, 5.0), ("A", t("2024-01-01T11:00:00"), 2, 9.0),
             ("A", t("2024-01-01T12:00:00"), 3, 4.0), ("A", t("2024-01-05T12:00:00"), 4, 4.0)]
    source = str(tmp_path / "ticks")
    spark.createDataFrame(ticks, "ticker STRING, ts TIMESTAMP, seq BIGINT, price DOUBLE").write.parquet(source)
    stream = spark.readStream.schema("ticker STRING, ts TIMESTAMP, seq BIGINT, price DOUBLE").parquet(source)
    query = refresh.write_bars(refresh.tick_bars(stream), str(tmp_path / "bars"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    # The last window stays open until later ticks move the watermark past it.
    assert rows(spark.read.parquet(str(tmp_path / "bars"))) == [("A", dt.date(2024, 1, 1), 5.0, 9.0, 4.0, 4.0)]


def test_refresh_recomputes_arrived_filings_only(spark, tmp_path):
    star = instance.load_filings(spark, filings(tmp_path / "docs"))
    star.write(str(tmp_path / "star"))
    target, arrivals = str(tmp_path / "out"), str(tmp_path / "arrivals")
    build = lambda s: s.fact.groupBy("filing_id").agg(F.count("*").alias("n"))

    def arrive(number):
        spark.createDataFrame([(number, dt.datetime(2024, 1, 1))] * 2, "filing_id BIGINT, arrived_at TIMESTAMP").write.mode("append").parquet(arrivals)
        refresh.refresh_statements(spark, arrivals, str(tmp_path / "star"), target, str(tmp_path / "cp"), build).awaitTermination(120)

    arrive(7)
    assert rows(refresh.current_rows(spark, target), "filing_id", "n") == [(7, 4)]
    arrive(12)
    assert rows(refresh.current_rows(spark, target), "filing_id", "n") == [(12, 4), (7, 4)]
    assert rows(spark.read.parquet(f"{target}/rows"), "filing_id", "n") == [(12, 4), (7, 4)]
    # A later batch that covers the filing replaces its rows, even by none.
    seven = spark.createDataFrame([(7,)], "filing_id BIGINT")
    refresh.write_version(spark.read.parquet(f"{target}/rows").drop("batch_id").limit(0), seven, target, 99)
    assert rows(refresh.current_rows(spark, target), "filing_id", "n") == [(12, 4)]
