"""Records of people derived from the customer and nation tables, in SQL that Spark and DuckDB both read.

Every seventh customer is a second entry of the one before it, with another spelling; fields go missing by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "Aarav,Priya,Rohit,Meera,Kenji,Fatima,William,Ines,Joseph,Amara,Lucas,Sofia,Noah,Emma,Liam,Olivia,Hugo,Clara,Marco,Giulia,Ivan,Elena,Omar,Layla,Chen,Yuki,Tariq,Nadia,Pablo,Lucia,Erik,Freja,Jonas,Anika,Samir,Zara,Diego,Camila,Felix,Greta,Arjun,Kavya,Daniel,Sara,Mateo,Valeria,Oscar,Alba,Viktor,Mila,Rafael,Bianca,Stefan,Irina,Karim,Huda,Wei,Mei,Ravi,Leela"
HEAD = "Zai,Ragh,Muk,Bos,Var,Sin,Whit,Das,Ker,Tal,Mor,Lind,Berg,Cas,Fon,Gar,Hol,Jan,Kov,Nov"
TAIL = "di,avan,herjee,tis,ma,ha,field,gupta,nel,vik,etti,gren,strom,tillo,seca,cia,mes,sen,ac,ak"
COMPANY = "Vantage,Northwind,Quanta Stack,Cardinal,Helix Grid,Delta,Obsidian Health,Slate Stack,Mehta & Co,Blue Harbor,Lumen,Orchard,Pioneer Freight,Tidal,Summit Robotics,Evergreen,Marlin,Keystone,Aurora Bio,Granite"
FORM = " Labs Inc.; Technologies; Pvt Ltd;; GmbH; (formerly Acme)"
TITLE = "VP Sales,Co-founder & CEO,Chief of Staff,Head of Growth,General Partner,Principal Engineer,CTO,Sr Product Mgr,Director of Revenue Operations,Solutions Architect"
RETITLE = "Vice President of Sales,CEO & Founder,Chief of Staff to the CEO,Growth Lead,GP,Principal Engineer (interim),Chief Technology Officer,Senior Product Manager,Dir. RevOps,Solutions Architect"
CITY = "Bangalore,NYC,SF Bay Area,London,Berlin,Paris,Singapore,Toronto,Someville,Mumbai"
NEED = "hiring engineers,seed capital,enterprise intros,go to market help,legal advice"
OFFER = "engineering talent,angel investment,enterprise network,sales coaching,legal review"


def pick(values: str, n: str, sep: str = ",") -> str:
    """The value at the position n modulo their number, n being an SQL expression of a non-negative integer."""
    return f"split_part('{values}', '{sep}', CAST(({n}) % {len(values.split(sep))} AS INT) + 1)"


PEOPLE_SQL = f"""
SELECT 'p-' || lpad(CAST(k AS STRING), 8, '0') AS id,
  CASE WHEN twin AND kind = 0 THEN upper(fn || ' ' || ln) WHEN twin AND kind = 1 THEN substr(fn, 1, 1) || '. ' || ln
    WHEN twin AND kind = 2 THEN 'Dr. ' || fn || ' ' || ln ELSE fn || ' ' || ln END AS full_name,
  CASE WHEN k % 11 = 5 THEN NULL WHEN twin AND kind = 1 THEN NULL WHEN p % 5 = 0 THEN lower(fn) || '.' || lower(ln) || CAST(p AS STRING) || CASE WHEN twin THEN '+crm' ELSE '' END || '@gmail.com'
    WHEN twin AND kind = 3 THEN upper(fn) || '.' || upper(ln) || CAST(p AS STRING) || '@' || firm || '.COM' ELSE lower(fn) || '.' || lower(ln) || CAST(p AS STRING) || '@' || firm || '.com' END AS email,
  CASE WHEN k % 6 = 1 THEN NULL WHEN twin AND kind = 2 THEN slug WHEN k % 29 = 4 THEN 'https://twitter.com/' || slug ELSE 'https://www.linkedin.com/in/' || slug || '/' END AS linkedin_url,
  CASE WHEN k % 17 = 2 THEN NULL WHEN k % 17 = 9 THEN '' WHEN twin AND kind = 3 THEN upper(corp) ELSE corp || {pick(FORM, "p", ";")} END AS company,
  CASE WHEN k % 19 = 3 THEN NULL WHEN twin THEN {pick(RETITLE, "p")} ELSE {pick(TITLE, "p")} END AS title,
  CASE WHEN k % 23 = 7 THEN NULL ELSE {pick(CITY, "p")} END AS location,
  CASE WHEN k % 13 = 4 THEN NULL WHEN twin THEN 'Works in ' || lower(c_mktsegment) ELSE 'Works in ' || lower(c_mktsegment) || ' across ' || n_name || ' with ' || CAST(p AS STRING) || ' customers' END AS bio,
  CASE WHEN k % 4 = 0 THEN 'applicant_form' WHEN k % 4 = 1 THEN 'airtable_export' WHEN k % 4 = 2 THEN 'event_list' ELSE 'crm' END AS source,
  CASE WHEN k % 10 = 6 THEN '[]' ELSE '["' || {pick(NEED, "k")} || '","' || {pick(NEED, "k + 1 + p % 3")} || '"]' END AS needs,
  CASE WHEN k % 10 = 6 THEN NULL WHEN k % 10 = 7 THEN {pick(OFFER, "p")} ELSE '["' || {pick(OFFER, "p")} || '"]' END AS offers,
  CASE WHEN k % 31 = 8 THEN NULL ELSE '2024-' || lpad(CAST(k % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(k % 28 + 1 AS STRING), 2, '0') END AS created_at
FROM (
  SELECT *, lower(replace(replace(corp, ' ', ''), '&', '')) AS firm, lower(fn) || '-' || lower(ln) || '-' || CAST(p AS STRING) AS slug
  FROM (
    SELECT k, p, k != p AS twin, CAST(floor(k / 7.0) AS BIGINT) % 4 AS kind, c_mktsegment, n_name,
      {pick(FIRST, "p * 13 + CAST(floor(p / 60.0) AS BIGINT) * 7")} AS fn,
      {pick(HEAD, "p * 7 + CAST(floor(p / 20.0) AS BIGINT)")} || {pick(TAIL, "p * 11 + CAST(floor(p / 400.0) AS BIGINT)")} AS ln,
      {pick(COMPANY, "p * 3 + CAST(floor(p / 9.0) AS BIGINT)")} AS corp
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 3 THEN c_custkey - 1 ELSE c_custkey END AS p, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) t0) t1) t2
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "customer", "nation")
    sql = PEOPLE_SQL.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}")
    return spark.sql(sql, **t)
