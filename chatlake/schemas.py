"""Schemas of the chat model."""

from __future__ import annotations

MESSAGES = """id bigint, type string, date string, date_unixtime bigint, from_name string, from_id string, reply_to_message_id bigint, forwarded_from string,
    forwarded_from_id string, text_plain string, text_length int, has_media int, has_photo int, has_links int, has_mentions int, is_edited int,
    edited_unixtime bigint, photo_file_size bigint, photo_width int, photo_height int, raw_json string"""
ENTITIES = "message_id bigint, type string, value string"
PARTICIPANTS = """user_id string, first_name string, last_name string, username string, phone string, is_bot int, is_admin int, is_creator int, is_premium int,
    join_date bigint, last_status string, last_online bigint, about string, updated_at bigint"""
CHUNKS = "chunk_id bigint, chunk_type string, text string, message_ids array<bigint>, anchor_message_id bigint, start_date string, end_date string, embedding array<float>"
