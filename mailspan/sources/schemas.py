"""Schemas of the mail tables."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DataType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_DDL = {
    "documents": "id string not null, title string not null, status string not null, documentType string, language string, sourceType string not null, thumbnailPath string, pageCount int not null, isFavorite boolean not null, createdAt bigint not null, modifiedAt bigint not null, syncStatus string not null",
    "document_pages": "id string not null, documentId string not null, pageNumber int not null, imagePath string not null, processedPath string, ocrText string, ocrConfidence float, width int not null, height int not null",
    "profiles": "id string not null, type string not null, name string not null, organization string, department string, street string, city string, postalCode string, country string, phone string, email string, website string, reference string, notes string, completionScore float not null, missingFields string, avatarPath string, createdAt bigint not null, modifiedAt bigint not null",
    "document_profile_links": "documentId string not null, profileId string not null, role string not null, createdAt bigint not null",
    "extracted_data": "id string not null, documentId string not null, fieldName string not null, fieldValue string not null, fieldType string not null, confidence float not null, pageNumber int, isConfirmed boolean not null, seq int",
    "timeline_events": "id string not null, documentId string not null, eventType string not null, title string not null, description string, data string, referenceId string, referenceType string, createdAt bigint not null",
    "tags": "id string not null, name string not null, color string",
    "document_tags": "documentId string not null, tagId string not null",
    "conversations": "id string not null, documentId string, aiModelId string, modelType string not null, title string not null, lastMessageAt bigint not null, messageCount int not null, isActive boolean not null, createdAt bigint not null",
    "messages": "id string not null, conversationId string not null, role string not null, content string not null, mediaType string not null, mediaPath string, toolCallId string, toolName string, toolArgs string, toolResult string, isStreaming boolean not null, createdAt bigint not null",
    "document_relations": "id string not null, sourceDocId string not null, targetDocId string not null, relationType string not null, createdAt bigint not null",
    "reminders": "id string not null, documentId string not null, title string not null, description string, dueDate bigint not null, isCompleted boolean not null, createdAt bigint not null",
}
_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "float": FloatType(), "boolean": BooleanType()}


def _field(text: str) -> StructField:
    name, kind, *rest = text.split()
    return StructField(name, _TYPES[kind], nullable=not rest)


SCHEMAS = {name: StructType([_field(x) for x in columns.split(", ")]) for name, columns in _DDL.items()}

#: Keys by which a second insert replaces a row.
KEYS = {name: ("id",) for name in SCHEMAS} | {"document_profile_links": ("documentId", "profileId"), "document_tags": ("documentId", "tagId")}

#: parent -> (child table, its column): rows that go when the parent row goes.
CASCADES = {
    "documents": (("document_pages", "documentId"), ("document_profile_links", "documentId"), ("extracted_data", "documentId"), ("timeline_events", "documentId"), ("document_tags", "documentId"), ("document_relations", "sourceDocId"), ("document_relations", "targetDocId"), ("reminders", "documentId")),
    "profiles": (("document_profile_links", "profileId"),),
    "tags": (("document_tags", "tagId"),),
    "conversations": (("messages", "conversationId"),),
}
