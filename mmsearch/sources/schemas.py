"""Declared schemas of files and tables."""

PROFILES = "username string, follower_count long, video_count long, video_ids string, video_durations_list string, video_desc_list string, tiktok_url string, pos long"
TRANSCRIPTIONS = "creator string, transcription string"
LABELS = "config string, image_weight double, text_weight double, query string, rank int, creator string, score double, relevant int"
CLUSTERS = "creator string, cluster_id int"
RUNS = "run int, s1_workers int, n_videos long, n_creators long, total_time_sec double, total_vps double"
WINNER = "config string, image_weight double, text_weight double, avg_precision_at_10 double"
INDEX = "pos long, creator string, img array<double>, txt array<double>, combined array<double>"
SEARCH_DOCS = "username string, transcription string, image_embedding array<double>, text_embedding array<double>, combined_embedding array<double>, follower_count long, video_count long"
INTERACTIONS = "username string, liked_creator string, query_context string, label string, timestamp timestamp"
VIDEO_TEXTS = "mp4 string, creator string, text string"
