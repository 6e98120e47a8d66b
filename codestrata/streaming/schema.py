from codestrata.schemas import Schema

#: Schema of Spark's binaryFile source.
BINARY_FILE = Schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
