"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

SEMANTIC = "domain string, concept string, action string, object string, obligation_type string, mandatory_flag string, confidence_score double"
PAGES = "stem string, page_no int, text string"
LINES = "stem string, line_no long, raw string"
NODES = "stem string, ord long, parent_ord long, type string, number string, heading string, text string, page_start int, page_end int"
CLAUSES = f"stem string, ord long, clause_id string, clause_no string, title string, text string, page_reference int, semantic struct<{SEMANTIC.replace(' ', ':').replace(',:', ',')}>"
CONCEPTS = "cat_ord int, canonical_id string, label string, definition string, domain string, parent string, status string, synonyms array<string>"
DOMAINS = "token string, label string, description string"
TOPICS = "name string, query string, days int, `limit` int, sort string"
STORY = "title string, url string, story_date string, metrics struct<significance:double>, geo struct<country:string,region:string,admin1:string,location:string>, top_articles array<struct<title:string,url:string,domain:string>>"
SCRAPED = "url string, title string, date string, pdf_url string, pdf_size string, body_text string, linked_documents array<struct<text:string,url:string>>, error string"
RUN_LOG = "stem string, step string, status string, detail string"
# Fields that a metadata hook may fill.
METADATA_FIELDS = [
    "document_id", "title", "regulator", "regulator_country", "source_type", "language", "publication_date", "effective_date",
    "implementation_deadline", "last_updated", "version", "status", "supersedes", "superseded_by", "regulation_type",
    "regulation_number", "business_domain", "industry", "jurisdiction", "applicable_entities", "keywords_from_document",
]
