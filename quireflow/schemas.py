"""Schemas of the engine's tables; nothing is inferred."""

ENTRIES = "archive_id string, cd_ordinal int, name string, name_bytes binary, method_code int, provider string, flags int, crc32 bigint, compressed_size bigint, uncompressed_size bigint, local_header_offset bigint, data_offset bigint, cd_record binary, payload binary, error string"
ARCHIVES = "archive_id string, file_size bigint, cd_offset bigint, cd_size bigint, entry_count bigint, live_bytes bigint, bloat_bytes bigint, bloat_ratio double, cd_hash binary, error string"
JOURNAL = "archive_id string, file_offset bigint, generation_id binary, kind string, sequence bigint, entry string, page_index bigint, data binary, op string, new_size bigint, new_name string, commit_sequence bigint, page_count bigint, page_size int, status string, truncation_point bigint"
INDEX_ENTRIES = "archive_id string, entry_idx bigint, name string, name_hash string, provider string, entry_flags int, method_code int, local_header_offset bigint, data_offset bigint, compressed_size bigint, uncompressed_size bigint, chunk_head_offset bigint, checkpoint_count bigint, commit_count bigint, error string"
CHECKPOINTS = "archive_id string, entry_idx bigint, name string, chunk_ordinal int, provider string, uncompressed_offset bigint, compressed_offset bigint, bits smallint, window binary, capacity bigint, frame_offset bigint"
OPS = "archive_id string, sequence bigint, op string, entry string, offset bigint, data binary, new_size bigint, new_name string"
OVERLAY = "archive_id string, name string, kind string, source string"
DIRTY_PAGES = "archive_id string, entry string, page_index bigint, stamp bigint, tier int, data binary"
DIRTY_ENTRIES = "archive_id string, entry string, logical_size bigint, source_size bigint"
