"""Schemas, keys, references and defaults of the eighteen tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of each table.
_COLUMNS = {
    "documents": "id string, organization_id string, bot_id string, source_id string, chunk_index int, content string,"
    " created_at timestamp, chunk_size int, chunk_overlap int, section_title string, token_count int,"
    " embedding_model string, embedding_version string, embedding_provider string, is_active boolean,"
    " deleted_at timestamp",
    "embeddings": "id string, document_id string, embedding array<float>, created_at timestamp, deleted_at timestamp",
    "messages": "id string, conversation_id string, created_at timestamp, updated_at timestamp, role string,"
    " content string",
    "training_jobs": "id string, organization_id string, bot_id string, status string, started_at timestamp,"
    " completed_at timestamp, error_message string",
    "retrieval_logs": "id string, organization_id string, bot_id string, conversation_id string, message_id string,"
    " query string, query_embedding array<float>, retrieved_document_ids array<string>,"
    " similarity_scores array<double>, retrieval_threshold double, retrieval_k int, reranker_used boolean,"
    " reranked_document_ids array<string>, created_at timestamp",
    "message_feedback": "id string, message_id string, feedback string, reason string, created_at timestamp",
    "model_config_versions": "id string, bot_id string, embedding_model string, llm_model string,"
    " reranker_model string, retrieval_k int, similarity_threshold double, chunk_size int, chunk_overlap int,"
    " active boolean, created_at timestamp",
    "organizations": "id string, created_at timestamp, is_email_verified boolean, name string, logo_url string,"
    " address variant, email string, phone string, email_token string",
    "bots": "id string, created_at timestamp, name string, capture_leads boolean, updated_at timestamp,"
    " organization_id string, tone string, role string, business_description string, first_message string,"
    " confirmation_message string, lead_capture_message string, lead_capture_timing string, capture_name boolean,"
    " capture_email boolean, capture_phone boolean, deleted_at timestamp, deleted_by string",
    "users": "id string, created_at timestamp, updated_at timestamp, email string, email_verified boolean,"
    " email_verified_at timestamp, password_hash string, phone string, phone_verified boolean,"
    " phone_verified_at timestamp, full_name string, avatar_url string, google_id string, github_id string,"
    " microsoft_id string, google_email string, github_email string, microsoft_email string,"
    " last_logged_in timestamp, last_logged_in_ip string, is_active boolean, is_banned boolean,"
    " banned_until timestamp, onboarding_completed boolean",
    "organization_members": "id string, created_at timestamp, organization_id string, role string, user_id string",
    "organization_invites": "id string, organization_id string, email string, role string, created_at timestamp,"
    " accepted_at timestamp",
    "otps": "id string, created_at timestamp, user_id string, code string, type string, purpose string, email string,"
    " phone string, expires_at timestamp, used_at timestamp, is_used boolean, attempts int, max_attempts int,"
    " ip_address string, user_agent string",
    "api_keys": "id string, name string, key_hash string, created_at timestamp, organization_id string,"
    " bot_id string, is_active boolean, last_used_at timestamp",
    "files": "id string, created_at timestamp, organization_id string, bot_id string, provider string, bucket string,"
    " path string, original_filename string, mime_type string, size_bytes bigint, purpose string, status string,"
    " deleted_at timestamp, deleted_by string",
    "training_sources": "id string, created_at timestamp, organization_id string, bot_id string, type string,"
    " status string, error_message string, source_value string, content_hash string, original_filename string,"
    " size_bytes bigint, mime_type string, deleted_at timestamp, deleted_by string",
    "conversations_meta": "id string, created_at timestamp, mode string, organization_id string, bot_id string,"
    " api_key_id string, user_name string, user_email string, status string, last_message_snippet string,"
    " last_message_at timestamp",
    "leads": "id string, captured_at timestamp, name string, email string, phone string, organization_id string,"
    " bot_id string, conversation_id string",
}

NOW = "now"

# What a missing value becomes when a row is stored.
DEFAULTS = {
    "documents": {"created_at": NOW, "is_active": True},
    "embeddings": {"created_at": NOW},
    "messages": {"created_at": NOW},
    "retrieval_logs": {"created_at": NOW},
    "message_feedback": {"created_at": NOW},
    "model_config_versions": {"active": False, "created_at": NOW},
    "organizations": {"created_at": NOW, "is_email_verified": False},
    "bots": {"created_at": NOW, "capture_leads": False, "updated_at": NOW, "capture_name": False,
             "capture_email": False, "capture_phone": False},
    "users": {"created_at": NOW, "updated_at": NOW, "email_verified": False, "phone_verified": False,
              "is_active": True, "is_banned": False, "onboarding_completed": False},
    "organization_members": {"created_at": NOW},
    "organization_invites": {"role": "editor", "created_at": NOW},
    "otps": {"created_at": NOW, "is_used": False, "attempts": 0, "max_attempts": 5},
    "api_keys": {"created_at": NOW, "is_active": True, "last_used_at": NOW},
    "files": {"created_at": NOW, "provider": "r2"},
    "training_sources": {"created_at": NOW},
    "conversations_meta": {"created_at": NOW, "mode": "ai"},
    "leads": {"captured_at": NOW},
}


class Reference(NamedTuple):
    """A column of a child table that must name a row of the parent, and what happens when that row goes."""

    child: str
    column: str
    parent: str
    on_delete: str


# References between tables.
REFERENCES = (
    Reference("embeddings", "document_id", "documents", "cascade"),
    Reference("message_feedback", "message_id", "messages", "none"),
    Reference("bots", "organization_id", "organizations", "cascade"),
    Reference("organization_members", "organization_id", "organizations", "cascade"),
    Reference("organization_members", "user_id", "users", "cascade"),
    Reference("organization_invites", "organization_id", "organizations", "cascade"),
    Reference("otps", "user_id", "users", "cascade"),
    Reference("api_keys", "organization_id", "organizations", "cascade"),
    Reference("api_keys", "bot_id", "bots", "cascade"),
    Reference("files", "organization_id", "organizations", "cascade"),
    Reference("files", "bot_id", "bots", "cascade"),
    Reference("training_sources", "organization_id", "organizations", "cascade"),
    Reference("training_sources", "bot_id", "bots", "cascade"),
    Reference("conversations_meta", "organization_id", "organizations", "cascade"),
    Reference("conversations_meta", "bot_id", "bots", "set_null"),
    Reference("conversations_meta", "api_key_id", "api_keys", "set_null"),
    Reference("leads", "organization_id", "organizations", "cascade"),
    Reference("leads", "bot_id", "bots", "set_null"),
    Reference("leads", "conversation_id", "conversations_meta", "set_null"),
)

# Keys that must be unique besides the ids.
UNIQUE_KEYS = (
    ("documents", ("source_id", "chunk_index", "embedding_model", "embedding_version")),
    ("embeddings", ("document_id",)),
    ("users", ("email",)),
    ("users", ("google_id",)),
    ("users", ("github_id",)),
    ("users", ("microsoft_id",)),
)

TABLES = tuple(_COLUMNS)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_COLUMNS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the table's columns, in order and type; columns that an older snapshot lacks become NULL."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in schema(table)])


def with_defaults(df: DataFrame, table: str, now) -> DataFrame:
    """Replace missing values by the table's defaults; ``now`` is one instant for the whole run."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(now if default == NOW else default).cast(df.schema[c].dataType))
        for c, default in DEFAULTS.get(table, {}).items() if c in df.columns
    })
