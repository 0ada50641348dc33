"""Schemas of the tables. seq and row_idx are orders of insertion, used for ties only."""

VERSION = "struct<version:string,label:string,is_latest:boolean,kb_source:string>"
PRODUCTS = f"id string, name string, description string, path string, categories array<string>, default_version string, latest_version string, versions array<{VERSION}>"
#: The product dimension as it is read, before defaults.
PRODUCTS_JSON = "id string, name string, description string, path string, categories array<string>, defaultVersion string, versions array<struct<version:string,label:string,isLatest:boolean,kbSource:string>>"
FILES = "path string, parts array<string>, content string, seq bigint"
NODES = (
    "id string, type string, label string, product_id string, version string, tier string, url string, path string, description string, "
    "knowledge_article_id string, sidebar_position string, level int, idx int, tokens int, is_latest boolean, categories array<string>, seq bigint"
)
EDGES = "src string, dst string, rel string, seq bigint"
ITEMS = (
    "lvl string, id string, type string, doc_id string, tier string, product string, version string, label string, title string, ref string, "
    "url string, heading_path array<string>, text string, row_idx bigint"
)
VECTORS = "lvl string, id string, row_idx bigint, provider string, model string, dim int, embedding array<float>"
LABELS = "qid string, query string, field string, golds array<string>, grp string, product string, target_tier string, seq bigint"
PARSED = (
    "data map<string,array<string>>, title string, headings array<struct<level:int,text:string,slug:string>>, links array<string>, images array<string>, "
    "preamble string, sections array<struct<level:int,text:string,slug:string,crumbs:array<string>,body:string>>, "
    "chunks array<struct<heading_path:array<string>,text:string,tokens:int>>"
)
