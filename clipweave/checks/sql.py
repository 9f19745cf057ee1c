"""The derived tables and every query again, as plain SQL.

Written against the operator definitions, not against the Spark code: windows,
recursion and list folds are used freely, without care for scale.
"""

from __future__ import annotations

import re

# The instruction that goes with a transcript, and the number of the piece that ends it.
PROMPT = """
The input contains a timestamped transcription of a video.
Select a 2-minute segment from the transcription that contains something interesting, useful, surprising, controversial, or thought-provoking.
The selected text should contain only complete sentences.
Do not cut the sentences in the middle.
The selected text should form a complete thought.
Return a JSON object with the following structure:
## Output 
[{
    start: "Start time of the segment in seconds (number)",
    content: "The transcribed text from the selected segment (clean text only, NO timestamps)",
    end: "End time of the segment in seconds (number)"
}]

## Input
"""
LAST_PIECE = 2147483647

# Derived tables ----------------------------------------------------------------

TABLES: dict[str, str] = {
    "sentences": r"""
        SELECT doc_id AS video_id, i - 1 AS seg_idx, s[i] AS sentence,
               len(string_split_regex(regexp_replace(s[i], '^\s+|\s+$', '', 'g'), '\s+')) AS n
        FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
              FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS s
                    FROM documents))""",
    "timed": """
        SELECT *, 4 * (sum(n) OVER (PARTITION BY video_id ORDER BY seg_idx) - n) AS began FROM sentences""",
    "segments": """
        SELECT video_id, seg_idx::INT AS seg_idx, ' ' || sentence AS text,
               began / 10.0::DOUBLE AS start_s, (began + 4 * n - seg_idx % 3) / 10.0::DOUBLE AS end_s FROM timed""",
    "videos": """
        SELECT doc_id AS video_id, text AS title,
               ([1920, 1280, 640, 3840, 400])[doc_id % 5 + 1] AS width,
               ([1080, 720, 480, 2160, 854])[doc_id % 5 + 1] AS height,
               ([30, 25, 24, 60, 30])[doc_id % 5 + 1]::DOUBLE AS fps,
               m + 60.0::DOUBLE AS duration_s
        FROM documents JOIN (SELECT video_id, max(end_s) AS m FROM segments GROUP BY 1) ON video_id = doc_id""",
    "replies": """
        SELECT doc_id AS video_id, CASE
            WHEN doc_id % 8 = 0 THEN ok WHEN doc_id % 16 = 9 THEN chr(10) || '[' || ok || ']' || chr(9)
            WHEN doc_id % 32 = 18 THEN chr(10)
            WHEN doc_id % 32 = 14 THEN '{"start": 100000, "content": "clip", "end": 100060}'
            WHEN doc_id % 8 = 1 THEN '[' || ok || ']'
            WHEN doc_id % 16 = 2 THEN '' WHEN doc_id % 8 = 2 THEN '{"topic": "none"}'
            WHEN doc_id % 8 = 3 THEN '{"start": -5, "content": "clip", "end": 60}'
            WHEN doc_id % 8 = 4 THEN '{"start": 90, "content": "clip", "end": 30.5}'
            WHEN doc_id % 8 = 5 THEN '{"start": "abc", "content": "clip", "end": 30}'
            WHEN doc_id % 8 = 6 THEN '{"start": 0, "content": "clip", "end": 45.2}'
            ELSE '{"start": 5.2, "content": "clip", "end": 5.9}' END AS response
        FROM (SELECT doc_id, '{"start": ' || (doc_id * 7 % 40 + 1) || '.5, "content": "clip", "end": '
                             || (doc_id * 7 % 40 + 120) || '.7}' AS ok FROM documents)""",
    "lines": r"""
        SELECT page_id * 2 AS line_no, url AS line FROM pages
        UNION ALL SELECT page_id * 2 + 1, '  ' || url || chr(9) FROM pages WHERE page_id % 10 = 1
        UNION ALL SELECT page_id * 2 + 1, '   ' FROM pages WHERE page_id % 10 = 2
        UNION ALL SELECT page_id * 2 + 1, '# ' || url FROM pages WHERE page_id % 10 = 3""",
    "items": r"""
        SELECT line_no, item FROM (SELECT line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS item FROM lines)
        WHERE item <> '' AND item NOT LIKE '#%'""",
    "titles": "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages",
    "streams": """
        SELECT l_orderkey AS video_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                  l_quantity, l_extendedprice) - 1 AS stream_idx,
               CASE WHEN l_linestatus = 'O' THEN 'video' ELSE 'audio' END AS type,
               ([2160, 1440, 1080, 720, 480, 360, 144])[l_linenumber] AS px,
               round(l_extendedprice * 1000)::BIGINT AS filesize, l_returnflag = 'R' AS is_progressive
        FROM lineitem""",
    "ranked": """
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY px DESC, stream_idx) - 1 AS rank,
               count(*) OVER (PARTITION BY video_id) AS n, stream_idx, px || 'p' AS resolution,
               round(filesize / 1048576, 2) AS size_mb,
               CASE WHEN is_progressive THEN 'Progressive' ELSE 'Adaptive' END AS kind, is_progressive
        FROM streams WHERE type = 'video'""",
    "answers": """
        SELECT o_orderkey AS video_id,
               (['0', '1', '2', '3', '7', NULL, NULL, NULL, NULL])[o_orderkey % 9 + 1]::INT AS pick FROM orders""",
    "chosen": """
        SELECT r.* FROM ranked r LEFT JOIN answers USING (video_id)
        WHERE rank = CASE WHEN pick < n THEN pick ELSE 0 END""",
    "boxes": """
        SELECT l_suppkey AS video_id, l_orderkey, round(l_discount * 100) / 10.0::DOUBLE AS confidence,
               (l_partkey % 1500)::INT AS x, (l_quantity * 10)::INT AS y,
               (l_partkey % 1500 + 20 + 15 * l_linenumber)::INT AS x1,
               (l_quantity * 10 + 20 + 10 * l_linenumber + l_partkey % 40)::INT AS y1,
               l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem""",
    "dense": """
        SELECT *, row_number() OVER (PARTITION BY video_id, frame_no ORDER BY l_orderkey, l_linenumber, l_partkey,
                                     l_quantity, l_extendedprice) - 1 AS det_idx
        FROM (SELECT *, l_orderkey % 60 AS frame_no FROM boxes)""",
    "sparse": """
        SELECT *, row_number() OVER (PARTITION BY video_id, frame_no ORDER BY l_orderkey, l_linenumber, l_partkey,
                                     l_quantity, l_extendedprice) - 1 AS det_idx
        FROM (SELECT *, l_orderkey % 600 AS frame_no FROM boxes)""",
    "frames": """
        SELECT video_id, unnest(range(n)) AS frame_no
        FROM (SELECT video_id, max(n) AS n
              FROM (SELECT user_id AS video_id, count(*) AS n FROM events GROUP BY 1
                    UNION ALL SELECT l_suppkey, max(l_orderkey % 600) + 1 FROM lineitem GROUP BY 1)
              GROUP BY 1)""",
    "audio": """
        SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
               event_type IN ('click', 'purchase') AS is_speech FROM events""",
    "pairs": "SELECT video_id, frame_no, is_speech FROM frames JOIN audio USING (video_id, frame_no)",
    "dims": """
        SELECT *, (v - v % 2)::INT AS vw, (height - height % 2)::INT AS vh
        FROM (SELECT *, trunc(height * 9 / 16)::INT AS v FROM videos)""",
    "scaled0": """
        SELECT *, CASE WHEN trunc(height * by_width) > vh THEN vh::DOUBLE / height ELSE by_width END AS scale
        FROM (SELECT *, vw::DOUBLE / (width::DOUBLE * 0.67::DOUBLE) AS by_width FROM dims)""",
    "scaled": """
        SELECT *, greatest(0, sw - vw) AS max_x, CASE WHEN vh > sh THEN floor((vh - sh) / 2)::INT ELSE 0 END AS offset_y
        FROM (SELECT *, trunc(width * scale)::INT AS sw, trunc(height * scale)::INT AS sh FROM scaled0)""",
    "motion": """
        SELECT video_id, sample_no, floor(p * sw / 32.0::DOUBLE)::INT AS x, 
               embedding[2 * p + 1]::DOUBLE * 10 AS fx, embedding[2 * p + 2]::DOUBLE * 10 AS fy
        FROM (SELECT label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_no,
                     embedding, unnest(range(32)) AS p FROM embeddings)
        JOIN scaled USING (video_id)""",
    "centroids": """
        SELECT video_id, sample_no, trunc(sum(x * w)::DOUBLE / sum(w)::DOUBLE)::INT AS centroid_x
        FROM (SELECT *, CASE WHEN sqrt(fx * fx + fy * fy) > 2.0
                             THEN floor(sqrt(fx * fx + fy * fy) * 1000000 + 0.5)::BIGINT END AS w FROM motion)
        GROUP BY ALL""",
    "goals": """
        SELECT video_id, sample_no, row_number() OVER (PARTITION BY video_id ORDER BY sample_no) AS rn,
               CASE WHEN sample_no > 0 AND centroid_x IS NOT NULL
                    THEN greatest(0, least(centroid_x - floor(vw / 2)::INT, sw - vw)) END AS goal
        FROM centroids JOIN scaled USING (video_id)""",
    "smoothed": """
        SELECT video_id, rn, sample_no, 0 AS smoothed_x FROM goals WHERE rn = 1
        UNION ALL
        SELECT g.video_id, g.rn, g.sample_no,
               CASE WHEN g.goal IS NULL THEN s.smoothed_x
                    ELSE trunc(0.90::DOUBLE * s.smoothed_x + 0.10::DOUBLE * g.goal)::INT END
        FROM smoothed s JOIN goals g ON g.video_id = s.video_id AND g.rn = s.rn + 1""",
    "kept_goals": """
        SELECT video_id, sample_no, goal, row_number() OVER (PARTITION BY video_id ORDER BY sample_no) AS rn
        FROM goals WHERE sample_no % 11 <> 5""",
    "kept_smoothed": """
        SELECT video_id, rn, sample_no, 0 AS smoothed_x FROM kept_goals WHERE rn = 1
        UNION ALL
        SELECT g.video_id, g.rn, g.sample_no,
               CASE WHEN g.goal IS NULL THEN s.smoothed_x
                    ELSE trunc(0.90::DOUBLE * s.smoothed_x + 0.10::DOUBLE * g.goal)::INT END
        FROM kept_smoothed s JOIN kept_goals g ON g.video_id = s.video_id AND g.rn = s.rn + 1""",
    "motion_frames": """
        SELECT video_id, fps, unnest(range((n * trunc(fps))::BIGINT)) AS frame_no
        FROM (SELECT label::BIGINT AS video_id, count(*) AS n FROM embeddings GROUP BY 1) JOIN videos USING (video_id)""",
    "offsets": """
        SELECT f.video_id, f.frame_no, coalesce(s.smoothed_x, 0) AS smoothed_x
        FROM motion_frames f ASOF LEFT JOIN smoothed s
          ON f.video_id = s.video_id AND floor(f.frame_no / trunc(f.fps)) >= s.sample_no""",
    "attempts": """
        SELECT video_id + attempt AS video_id, attempt, response
        FROM replies, (SELECT unnest([0, 1, 2]) AS attempt)""",
    "tried": """
        SELECT t.video_id, t.attempt, start_s, stop_s, status <> 'ok' AS failed,
               CASE WHEN d.doc_id IS NULL THEN NULL WHEN k < 2 THEN 'regenerate' WHEN k = 2 THEN 'cancel' ELSE 'approve' END AS decision
        FROM (SELECT a.video_id, attempt, p.start_s, p.stop_s, p.status, (a.video_id // 8 + attempt) % 5 AS k
              FROM attempts a JOIN parsed p ON p.video_id = a.video_id - a.attempt) t
        LEFT JOIN documents d ON d.doc_id = t.video_id""",
    "settled": """
        SELECT video_id, attempt, start_s, stop_s, NOT failed OR attempt > 0 AS highlight_ok,
               CASE WHEN failed AND attempt > 0 THEN 'regenerate_failed' WHEN decision = 'cancel' THEN 'cancel' ELSE 'approve' END AS decision
        FROM tried WHERE failed OR decision IS DISTINCT FROM 'regenerate'
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY attempt) = 1""",
    "parsed0": """
        SELECT video_id, response, CASE WHEN json_valid(response) THEN
                   CASE WHEN json_type(response) = 'ARRAY' THEN json_extract(response, '$[0]') ELSE response::JSON END END AS r
        FROM replies""",
    "parsed1": """
        SELECT *, json_extract_string(r, '$.start') AS a, json_extract_string(r, '$.end') AS b,
               json_extract_string(r, '$.content') AS content FROM parsed0""",
    "parsed2": """
        SELECT *, trunc(TRY_CAST(a AS DOUBLE))::INT AS s, trunc(TRY_CAST(b AS DOUBLE))::INT AS e FROM parsed1""",
    "parsed": r"""
        SELECT video_id, status, CASE WHEN status = 'ok' THEN s END AS start_s, CASE WHEN status = 'ok' THEN e END AS stop_s,
               CASE WHEN status = 'ok' THEN content END AS content
        FROM (SELECT *, CASE WHEN coalesce(regexp_replace(response, '^\s+|\s+$', '', 'g'), '') IN ('', 'null') THEN 'empty'
                             WHEN a IS NULL OR b IS NULL OR content IS NULL THEN 'bad_structure'
                             WHEN s IS NULL OR e IS NULL THEN 'unparseable'
                             WHEN s < 0 OR e < 0 THEN 'negative'
                             WHEN e <= s THEN 'end_not_after_start' ELSE 'ok' END AS status FROM parsed2)""",
    "gated": "SELECT video_id, start_s, stop_s FROM parsed WHERE start_s > 0 AND stop_s > 0 AND stop_s > start_s",
    "ranges": """
        SELECT video_id, start_s, least(stop_s::DOUBLE, top) AS end_s, least(stop_s::DOUBLE, top) - start_s AS clip_s,
               CASE WHEN start_s >= top THEN 'out_of_range' ELSE 'ok' END AS clip_status
        FROM gated JOIN (SELECT video_id, duration_s - 0.1::DOUBLE AS top FROM videos) USING (video_id)""",
    "clips": "SELECT *, 0 AS clip_idx FROM ranges WHERE clip_status = 'ok'",
    "touching": r"""
        SELECT c.video_id, clip_idx, clip_s, seg_idx, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
               s.start_s - c.start_s AS a, s.end_s - c.start_s AS b
        FROM clips c JOIN segments s ON s.video_id = c.video_id AND s.end_s - c.start_s > 0 AND s.start_s - c.start_s < clip_s""",
    "captions": """
        SELECT video_id, clip_idx, seg_idx, text, greatest(0.0::DOUBLE, a) AS start_s, least(clip_s, b) AS end_s, 'caption' AS status
        FROM touching WHERE text <> ''
        UNION ALL
        SELECT video_id, clip_idx, NULL, NULL, NULL, NULL, 'no_overlap' FROM clips
        WHERE (video_id, clip_idx) NOT IN (SELECT (video_id, clip_idx) FROM touching)""",
    "overlays": """
        SELECT *, CASE WHEN seg_idx % 3 = 0 THEN 'white' ELSE 'yellow' END AS color FROM segments WHERE end_s - start_s >= 0.5""",
    "transcripts": r"""
        SELECT video_id, (seg_idx // 4096)::INT AS part_no,
               string_agg(start_s::VARCHAR || ' - ' || end_s::VARCHAR || ': ' || text || chr(10), '' ORDER BY seg_idx) AS transcript
        FROM segments GROUP BY ALL""",
    "faces30": """
        SELECT video_id, frame_no, x, y, x1 - x AS w, y1 - y AS h, (x1 - x)::BIGINT * (y1 - y) AS area
        FROM dense WHERE frame_no < 30 AND x1 - x >= 30 AND y1 - y >= 30
        QUALIFY row_number() OVER (PARTITION BY video_id, frame_no ORDER BY area DESC, det_idx) = 1""",
    "medians": """
        SELECT video_id, l[floor(len(l) / 2)::INT + 1] + 60 AS m
        FROM (SELECT video_id, list_sort(list(x + floor(w / 2)::INT)) AS l FROM faces30 GROUP BY 1)""",
    "crops": """
        SELECT video_id, CASE WHEN width < vw THEN 'reject' WHEN m IS NULL THEN 'motion' ELSE 'face' END AS mode,
               CASE WHEN width < vw THEN NULL WHEN m IS NULL THEN 0
                    ELSE greatest(0, least(m - floor(vw / 2)::INT, width - vw)) END AS x_start
        FROM dims LEFT JOIN medians USING (video_id)""",
    "seen": """
        SELECT *, row_number() OVER (PARTITION BY video_id, frame_no ORDER BY l_orderkey, l_linenumber, l_partkey,
                                     l_quantity, l_extendedprice) - 1 AS det_idx
        FROM (SELECT b.*, l_orderkey * 7 % floor(duration_s * fps)::BIGINT AS frame_no
              FROM boxes b JOIN videos v ON b.video_id = v.video_id)""",
    "clip_faces": """
        SELECT c.video_id, c.clip_idx, x + floor((x1 - x) / 2)::INT AS centre
        FROM clips c JOIN videos v ON c.video_id = v.video_id
        JOIN seen s ON s.video_id = c.video_id AND s.frame_no >= floor(c.start_s * fps)
                   AND s.frame_no < floor(c.start_s * fps) + 30
        WHERE x1 - x >= 30 AND y1 - y >= 30
        QUALIFY row_number() OVER (PARTITION BY c.video_id, c.clip_idx, s.frame_no
                                   ORDER BY (x1 - x)::BIGINT * (y1 - y) DESC, det_idx) = 1""",
    "clip_medians": """
        SELECT video_id, clip_idx, l[floor(len(l) / 2)::INT + 1] + 60 AS m
        FROM (SELECT video_id, clip_idx, list_sort(list(centre)) AS l FROM clip_faces GROUP BY ALL)""",
    "cropped": """
        SELECT c.video_id, c.clip_idx, CASE WHEN width < vw THEN 'reject' WHEN m IS NULL THEN 'motion' ELSE 'face' END AS mode,
               CASE WHEN width < vw THEN NULL WHEN m IS NULL THEN 0
                    ELSE greatest(0, least(m - floor(vw / 2)::INT, width - vw)) END AS x_start
        FROM clips c JOIN dims d ON d.video_id = c.video_id
        LEFT JOIN clip_medians m ON m.video_id = c.video_id AND m.clip_idx = c.clip_idx""",
    # Crops of clips frame by frame, for single clips and for many; spelled out once for both.
    "clip_centroids": """
        SELECT video_id, sample_no, trunc(sum(x * w)::DOUBLE / sum(w)::DOUBLE)::INT AS centroid_x
        FROM (SELECT v.video_id, sample_no, floor(p * sw / 32.0::DOUBLE)::INT AS x,
                     CASE WHEN sqrt(fx * fx + fy * fy) > 2.0 THEN floor(sqrt(fx * fx + fy * fy) * 1000000 + 0.5)::BIGINT END AS w
              FROM (SELECT video_id, sample_no, p, embedding[2 * p + 1]::DOUBLE * 10 AS fx, embedding[2 * p + 2]::DOUBLE * 10 AS fy
                    FROM (SELECT label::BIGINT * 8 AS video_id, embedding, unnest(range(32)) AS p,
                                 row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_no FROM embeddings)) v JOIN scaled s ON s.video_id = v.video_id)
        GROUP BY ALL""",
    "clip_goals": """
        SELECT c.video_id, c.clip_idx, m.sample_no, row_number() OVER (PARTITION BY c.video_id, c.clip_idx ORDER BY m.sample_no) AS rn,
               CASE WHEN row_number() OVER (PARTITION BY c.video_id, c.clip_idx ORDER BY m.sample_no) > 1 AND centroid_x IS NOT NULL
                    THEN greatest(0, least(centroid_x - floor(vw / 2)::INT, sw - vw)) END AS goal
        FROM clips c JOIN scaled s ON s.video_id = c.video_id
        JOIN clip_centroids m ON m.video_id = c.video_id AND m.sample_no * trunc(fps) >= floor(c.start_s * fps)
                             AND m.sample_no * trunc(fps) < floor(c.end_s * fps)""",
    "clip_smoothed": """
        SELECT video_id, clip_idx, rn, sample_no, 0 AS smoothed_x FROM clip_goals WHERE rn = 1
        UNION ALL
        SELECT g.video_id, g.clip_idx, g.rn, g.sample_no,
               CASE WHEN g.goal IS NULL THEN s.smoothed_x
                    ELSE trunc(0.90::DOUBLE * s.smoothed_x + 0.10::DOUBLE * g.goal)::INT END
        FROM clip_smoothed s JOIN clip_goals g ON g.video_id = s.video_id AND g.clip_idx = s.clip_idx AND g.rn = s.rn + 1""",
    "clip_frames": """
        SELECT c.video_id, c.clip_idx, x.mode, f, CASE x.mode WHEN 'face' THEN x.x_start ELSE coalesce(s.smoothed_x, 0) END AS o
        FROM (SELECT c.video_id, clip_idx, fps, floor(c.start_s * fps)::BIGINT AS b,
                     unnest(range((floor(c.end_s * fps) - floor(c.start_s * fps))::BIGINT)) AS f
              FROM clips c JOIN videos v ON v.video_id = c.video_id) c
        JOIN cropped x ON x.video_id = c.video_id AND x.clip_idx = c.clip_idx AND x.mode <> 'reject'
        ASOF LEFT JOIN clip_smoothed s
          ON s.video_id = c.video_id AND s.clip_idx = c.clip_idx AND floor((c.b + c.f) / trunc(c.fps)) >= s.sample_no""",
    "clip_ranges": """
        SELECT video_id, clip_idx, mode, o, min(f) AS first_frame, max(f) AS last_frame
        FROM (SELECT *, f - row_number() OVER (PARTITION BY video_id, clip_idx, o ORDER BY f) AS island FROM clip_frames)
        GROUP BY video_id, clip_idx, mode, o, island""",
    "clip_windows": """
        SELECT r.video_id, clip_idx, row_number() OVER (PARTITION BY r.video_id, clip_idx ORDER BY first_frame) - 1 AS range_no, mode,
               first_frame::INT AS first_frame, last_frame::INT AS last_frame,
               CASE WHEN e - o < vw THEN greatest(0, e - vw) ELSE o END AS crop_x, e AS crop_x2
        FROM (SELECT r.*, vw, least(o + vw, CASE mode WHEN 'face' THEN width ELSE sw END) AS e
              FROM clip_ranges r JOIN scaled s ON s.video_id = r.video_id) r""",
    "many_clip_goals": """
        SELECT c.video_id, c.clip_idx, m.sample_no, row_number() OVER (PARTITION BY c.video_id, c.clip_idx ORDER BY m.sample_no) AS rn,
               CASE WHEN row_number() OVER (PARTITION BY c.video_id, c.clip_idx ORDER BY m.sample_no) > 1 AND centroid_x IS NOT NULL
                    THEN greatest(0, least(centroid_x - floor(vw / 2)::INT, sw - vw)) END AS goal
        FROM many_cut c JOIN scaled s ON s.video_id = c.video_id
        JOIN clip_centroids m ON m.video_id = c.video_id AND m.sample_no * trunc(fps) >= floor(c.start_s * fps)
                             AND m.sample_no * trunc(fps) < floor(c.end_s * fps)""",
    "many_clip_smoothed": """
        SELECT video_id, clip_idx, rn, sample_no, 0 AS smoothed_x FROM many_clip_goals WHERE rn = 1
        UNION ALL
        SELECT g.video_id, g.clip_idx, g.rn, g.sample_no,
               CASE WHEN g.goal IS NULL THEN s.smoothed_x
                    ELSE trunc(0.90::DOUBLE * s.smoothed_x + 0.10::DOUBLE * g.goal)::INT END
        FROM many_clip_smoothed s JOIN many_clip_goals g ON g.video_id = s.video_id AND g.clip_idx = s.clip_idx AND g.rn = s.rn + 1""",
    "many_clip_frames": """
        SELECT c.video_id, c.clip_idx, x.mode, f, CASE x.mode WHEN 'face' THEN x.x_start ELSE coalesce(s.smoothed_x, 0) END AS o
        FROM (SELECT c.video_id, clip_idx, fps, floor(c.start_s * fps)::BIGINT AS b,
                     unnest(range((floor(c.end_s * fps) - floor(c.start_s * fps))::BIGINT)) AS f
              FROM many_cut c JOIN videos v ON v.video_id = c.video_id) c
        JOIN many_cropped x ON x.video_id = c.video_id AND x.clip_idx = c.clip_idx AND x.mode <> 'reject'
        ASOF LEFT JOIN many_clip_smoothed s
          ON s.video_id = c.video_id AND s.clip_idx = c.clip_idx AND floor((c.b + c.f) / trunc(c.fps)) >= s.sample_no""",
    "many_clip_ranges": """
        SELECT video_id, clip_idx, mode, o, min(f) AS first_frame, max(f) AS last_frame
        FROM (SELECT *, f - row_number() OVER (PARTITION BY video_id, clip_idx, o ORDER BY f) AS island FROM many_clip_frames)
        GROUP BY video_id, clip_idx, mode, o, island""",
    "many_clip_windows": """
        SELECT r.video_id, clip_idx, row_number() OVER (PARTITION BY r.video_id, clip_idx ORDER BY first_frame) - 1 AS range_no, mode,
               first_frame::INT AS first_frame, last_frame::INT AS last_frame,
               CASE WHEN e - o < vw THEN greatest(0, e - vw) ELSE o END AS crop_x, e AS crop_x2
        FROM (SELECT r.*, vw, least(o + vw, CASE mode WHEN 'face' THEN width ELSE sw END) AS e
              FROM many_clip_ranges r JOIN scaled s ON s.video_id = r.video_id) r""",
    "unique_boxes": """
        SELECT video_id, x, y, x1 - x AS w, y1 - y AS h, min((frame_no, det_idx)) AS seen, min(frame_no) AS first_frame
        FROM dense GROUP BY ALL""",
    "kept_faces": """
        SELECT b.* FROM unique_boxes b
        WHERE (SELECT count(*) FROM unique_boxes o WHERE o.video_id = b.video_id AND o.first_frame < b.first_frame) < 5""",
    "faces": """
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY seen) - 1 AS face_no, first_frame, x, y, w, h
        FROM kept_faces""",
    "windows0": """
        SELECT f.*, width, height, trunc(height * 0.9::DOUBLE)::INT AS target_h,
               trunc(trunc(height * 0.9::DOUBLE) * 0.5625::DOUBLE)::INT AS target_w FROM faces f JOIN videos USING (video_id)""",
    "windows": """
        SELECT video_id, face_no, target_w, target_h, crop_x, crop_y, least(crop_x + target_w, width) AS crop_x2,
               least(crop_y + target_h, height) AS crop_y2
        FROM (SELECT *, greatest(0, x + floor((w - target_w) / 2)::INT) AS crop_x,
                     greatest(0, y + floor((h - target_h) / 2)::INT) AS crop_y FROM windows0)""",
    "lips": "SELECT *, abs(y + floor(2 * (y1 - y) / 3)::INT - y1) AS lip FROM {boxes}",
    "speakers": """
        SELECT p.video_id, p.frame_no, lip, x, y, x1, y1, lip IS NOT NULL AND is_speech AS is_active
        FROM pairs p LEFT JOIN (
            SELECT *, abs(y + floor(2 * (y1 - y) / 3)::INT - y1) AS lip FROM sparse WHERE confidence > 0.3
            QUALIFY row_number() OVER (PARTITION BY video_id, frame_no ORDER BY lip DESC, det_idx) = 1
        ) b USING (video_id, frame_no)""",
    "prompts": "SELECT event_id AS prompt_id, user_id, ts FROM events WHERE event_type = 'view'",
    "decisions": """
        SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'y' WHEN 'purchase' THEN ' R ' WHEN 'error' THEN 'n' ELSE '' END AS answer
        FROM events WHERE event_type <> 'view'""",
    "answered": """
        SELECT prompt_id, user_id, a.answer AS answer, a.w AS wait_us FROM (
            SELECT p.prompt_id, p.user_id, min((epoch_us(d.ts) - epoch_us(p.ts), d.answer)::STRUCT(w BIGINT, answer VARCHAR)) AS a
            FROM prompts p LEFT JOIN decisions d
              ON d.user_id = p.user_id AND d.ts >= p.ts AND d.ts <= p.ts + INTERVAL 2 HOUR
            GROUP BY ALL)""",
    "run_state": """
        SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'pending' END AS status
        FROM orders""",
    "channel": """
        SELECT url, (['videos', 'streams', 'shorts', 'playlists'])[(page_id + k) % 4 + 1] AS tab, length(html)::DOUBLE AS duration_s,
               page_id * 37 % 1000 AS view_count, page_id * 11 % 365 AS upload_date
        FROM (SELECT *, unnest([0, 2]) AS k FROM pages)""",
    "edges": r"""
        SELECT video_id, seg_idx, start_s, end_s, regexp_matches(text, '[.!?]\s*$') AS closes,
               coalesce(lag(regexp_matches(text, '[.!?]\s*$')) OVER (PARTITION BY video_id ORDER BY seg_idx), true) AS opens
        FROM segments""",
    "spans": """
        SELECT a.video_id, a.seg_idx AS first_idx, b.seg_idx AS last_idx, a.start_s, b.end_s, b.end_s - a.start_s AS span_s
        FROM edges a JOIN edges b ON a.video_id = b.video_id AND a.opens AND b.closes AND b.seg_idx >= a.seg_idx
             AND b.end_s - a.start_s BETWEEN 110.0::DOUBLE AND 130.0::DOUBLE""",
    "scored": """
        SELECT *, -abs(span_s - 120.0::DOUBLE) AS score,
               row_number() OVER (PARTITION BY video_id ORDER BY -abs(span_s - 120.0::DOUBLE) DESC, spot, first_idx, last_idx) AS turn,
               row_number() OVER (PARTITION BY video_id ORDER BY passes DESC, CASE WHEN passes THEN -abs(span_s - 120.0::DOUBLE) END DESC,
                   spot, first_idx, last_idx) AS clip_turn
        FROM (SELECT *, (first_idx::BIGINT * 2654435761 + last_idx::BIGINT * 40503) % 4294967296 AS spot,
                     trunc(start_s) > 0 AND trunc(end_s) > trunc(start_s) AS passes FROM spans)""",
    "greedy": """
        SELECT video_id, list_reduce(l, lambda acc, x: CASE
                   WHEN len(list_filter(acc, lambda k: k.start_s < x[1].end_s AND x[1].start_s < k.end_s)) > 0 THEN acc
                   ELSE list_concat(acc, x) END) AS kept
        FROM (SELECT video_id, list([{'first_idx': first_idx, 'last_idx': last_idx, 'start_s': start_s, 'end_s': end_s,
                                      'span_s': span_s, 'score': score}] ORDER BY turn) AS l
              FROM scored GROUP BY 1)""",
    "greedy_clips": """
        SELECT video_id, list_reduce(l, lambda acc, x: CASE
                   WHEN len(list_filter(acc, lambda k: k.start_s < x[1].end_s AND x[1].start_s < k.end_s)) > 0 THEN acc
                   ELSE list_concat(acc, x) END) AS kept
        FROM (SELECT video_id, list([{'first_idx': first_idx, 'last_idx': last_idx, 'start_s': start_s, 'end_s': end_s,
                                      'span_s': span_s, 'score': score}] ORDER BY clip_turn) AS l
              FROM scored GROUP BY 1)""",
    "many": """
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY s) - 1 AS clip_idx, s AS start_s,
               least(e::DOUBLE, top) AS end_s, least(e::DOUBLE, top) - s AS clip_s,
               CASE WHEN s <= 0 OR e <= s THEN 'bad_highlight' WHEN s >= top THEN 'out_of_range' ELSE 'ok' END AS clip_status
        FROM (SELECT video_id, trunc(k.start_s)::INT AS s, trunc(k.end_s)::INT AS e
              FROM (SELECT video_id, unnest(kept) AS k FROM greedy_clips))
        JOIN (SELECT video_id, duration_s - 0.1::DOUBLE AS top FROM videos) USING (video_id)""",
    "one_captions": "SELECT video_id, clip_idx, count(seg_idx) AS n FROM captions GROUP BY ALL",
    "many_cut": "SELECT * FROM many WHERE clip_status = 'ok'",
    "many_faces": """
        SELECT c.video_id, c.clip_idx, x + floor((x1 - x) / 2)::INT AS centre
        FROM many_cut c JOIN videos v ON c.video_id = v.video_id
        JOIN seen s ON s.video_id = c.video_id AND s.frame_no >= floor(c.start_s * fps)
                   AND s.frame_no < floor(c.start_s * fps) + 30
        WHERE x1 - x >= 30 AND y1 - y >= 30
        QUALIFY row_number() OVER (PARTITION BY c.video_id, c.clip_idx, s.frame_no
                                   ORDER BY (x1 - x)::BIGINT * (y1 - y) DESC, det_idx) = 1""",
    "many_medians": """
        SELECT video_id, clip_idx, l[floor(len(l) / 2)::INT + 1] + 60 AS m
        FROM (SELECT video_id, clip_idx, list_sort(list(centre)) AS l FROM many_faces GROUP BY ALL)""",
    "many_cropped": """
        SELECT c.video_id, c.clip_idx, CASE WHEN width < vw THEN 'reject' WHEN m IS NULL THEN 'motion' ELSE 'face' END AS mode,
               CASE WHEN width < vw THEN NULL WHEN m IS NULL THEN 0
                    ELSE greatest(0, least(m - floor(vw / 2)::INT, width - vw)) END AS x_start
        FROM many_cut c JOIN dims d ON d.video_id = c.video_id
        LEFT JOIN many_medians m ON m.video_id = c.video_id AND m.clip_idx = c.clip_idx""",
    "many_captions": r"""
        SELECT c.video_id, clip_idx, count(*) AS n
        FROM many_cut c JOIN segments s ON s.video_id = c.video_id AND s.end_s - c.start_s > 0 AND s.start_s - c.start_s < clip_s
        WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL""",
    "outcomes": """
        SELECT video_id, status, CASE WHEN status IN ('highlight_failed', 'crashed', 'out_of_range', 'too_narrow') THEN 1 ELSE 0 END AS exit_code
        FROM (SELECT v.video_id, CASE WHEN v.video_id % 50 = 7 THEN 'no_video' WHEN v.video_id % 50 = 8 THEN 'no_audio'
                     WHEN n IS NULL OR v.video_id % 50 = 9 THEN 'no_transcript' WHEN status <> 'ok' THEN 'highlight_failed'
                     WHEN v.video_id % 11 = 3 THEN 'cancelled' WHEN v.video_id % 11 = 5 THEN 'crashed'
                     WHEN NOT (start_s > 0 AND stop_s > 0 AND stop_s > start_s) THEN 'bad_highlight'
                     WHEN start_s >= duration_s - 0.1::DOUBLE THEN 'out_of_range'
                     WHEN width < trunc(height * 9 / 16) - trunc(height * 9 / 16) % 2 THEN 'too_narrow' ELSE 'success' END AS status
              FROM videos v JOIN parsed USING (video_id)
              LEFT JOIN (SELECT video_id, count(*) AS n FROM segments GROUP BY 1) USING (video_id))""",
    "nms_kept": """
        SELECT video_id, frame_no, list_reduce(l, lambda acc, b: CASE
                   WHEN len(list_filter(acc, lambda k: iou_hit(k, b[1]))) > 0 THEN acc ELSE list_concat(acc, b) END) AS kept
        FROM (SELECT video_id, frame_no, list([{'det_idx': det_idx, 'confidence': confidence, 'x': x, 'y': y, 'x1': x1, 'y1': y1}]
                                              ORDER BY confidence DESC, det_idx) AS l
              FROM (SELECT * FROM dense WHERE confidence > 0.01
                    QUALIFY row_number() OVER (PARTITION BY video_id, frame_no ORDER BY confidence DESC, det_idx) <= 400)
              GROUP BY ALL)""",
}
del TABLES["lips"]

# Intersection over union above 0.45, spelled out where a fold needs it.
_W = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x, {b}.x))::DOUBLE"
_H = "greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y, {b}.y))::DOUBLE"
_SIZE = "({a}.x1 - {a}.x)::DOUBLE * ({a}.y1 - {a}.y)::DOUBLE"
_INTER = f"({_W} * {_H})"
_HIT = f"({_INTER} / ({_SIZE} + {_SIZE.replace('{a}', '{b}')} - {_INTER}) > 0.45)"
TABLES["nms_kept"] = TABLES["nms_kept"].replace("iou_hit(k, b[1])", _HIT.format(a="k", b="b[1]"))

RECURSIVE = {"smoothed", "kept_smoothed", "clip_smoothed", "many_clip_smoothed"}


def _with(sql: str) -> str:
    """Put the derived tables a statement names in front of it."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in TABLES:
            if name != own and name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(TABLES[name], name)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    recursive = "RECURSIVE " if RECURSIVE & set(needed) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed) + "\n" + sql


# Queries -------------------------------------------------------------------------

_STYLE = {
    "animation_style": "CASE WHEN seg_idx % 3 = 2 THEN 'none' ELSE 'fade' END",
    "bg_opacity": "'0.7'",
    "color": "color",
    "font": "'DejaVu-Sans-Bold'",
    "fontsize": "'15'",
    "line_height": "'1.2'",
    "position": "CASE WHEN seg_idx % 3 = 2 THEN 'center,center' ELSE 'center,bottom' END",
    "stroke_color": "'black'",
    "stroke_width": "'1'",
}

_SLUG = r"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[<>:"/\\|?*\[\]]', '', 'g'),
    '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)"""

QUERIES_SQL: dict[str, str] = {
    "read_items": "SELECT line_no, item FROM items",
    "preview_items": """
        SELECT n AS position, printf('%03d. %s', n, item) AS preview
        FROM (SELECT item, row_number() OVER (ORDER BY line_no) AS n FROM items)""",
    "route_inputs": """
        SELECT o_orderkey AS line_no, '/videos/' || o_orderkey || '.mp4' AS item,
               CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'file' ELSE 'url' END AS route FROM orders""",
    "title_from_path": r"""
        SELECT page_id, CASE WHEN base = '' THEN '.webm' ELSE base END AS local, CASE WHEN base = '' THEN '.mp4' ELSE base END AS fetched
        FROM (SELECT page_id, string_split(url, '/')[-1] AS base FROM pages)""",
    "rank_streams": "SELECT video_id, rank, stream_idx, resolution, size_mb, kind FROM ranked WHERE rank < 5",
    "choose_stream": "SELECT video_id, rank, stream_idx, resolution, size_mb, kind, is_progressive FROM chosen",
    "attach_audio": """
        SELECT video_id, stream_idx, is_progressive, CASE WHEN NOT is_progressive THEN a END AS audio_idx
        FROM chosen LEFT JOIN (SELECT video_id, min(stream_idx) AS a FROM streams WHERE type = 'audio' GROUP BY 1) USING (video_id)""",
    "read_segments": "SELECT video_id, seg_idx, text, start_s, end_s FROM segments",
    "pending_transcription": "SELECT video_id, duration_s FROM videos WHERE video_id NOT IN (SELECT doc_id FROM labels)",
    "clip_manifest": f"""
        SELECT c.video_id, c.clip_idx, 'https://example.org/watch/' || c.video_id AS source, start_s, end_s, vw AS vertical_w,
               vh AS vertical_h, mode, x_start, coalesce(r.k, 0) AS n_ranges, coalesce(plan, '') AS crop_plan,
               coalesce(n, 0) AS n_captions,
               CASE WHEN title = '' THEN 'output' ELSE {_SLUG.format("title")} END || '_' || key || '_short.mp4' AS output,
               'audio_' || key || '.wav' AS audio_file, 'temp_clip_' || key || '.mp4' AS clip_file,
               'temp_cropped_' || key || '.mp4' AS cropped_file, 'temp_subtitled_' || key || '.mp4' AS subtitled_file,
               CASE WHEN clip_status <> 'ok' THEN clip_status WHEN mode = 'reject' THEN 'too_narrow' ELSE 'planned' END AS status
        FROM (SELECT *, substr(sha256(video_id || '|' || clip_idx), 1, 8) AS key FROM clips) c
        JOIN dims d ON d.video_id = c.video_id
        LEFT JOIN cropped x ON x.video_id = c.video_id AND x.clip_idx = c.clip_idx
        LEFT JOIN (SELECT video_id, clip_idx, count(*) AS k,
                          string_agg(first_frame || '-' || last_frame || '@' || crop_x, ';' ORDER BY range_no) AS plan
                   FROM clip_windows GROUP BY ALL) r ON r.video_id = c.video_id AND r.clip_idx = c.clip_idx
        LEFT JOIN one_captions n ON n.video_id = c.video_id AND n.clip_idx = c.clip_idx""",
    "many_clip_manifest": f"""
        SELECT c.video_id, c.clip_idx, 'https://example.org/watch/' || c.video_id AS source, start_s, end_s, vw AS vertical_w,
               vh AS vertical_h, mode, x_start, coalesce(r.k, 0) AS n_ranges, coalesce(plan, '') AS crop_plan,
               coalesce(n, 0) AS n_captions,
               CASE WHEN title = '' THEN 'output' ELSE {_SLUG.format("title")} END || '_' || key || '_short.mp4' AS output,
               'audio_' || key || '.wav' AS audio_file, 'temp_clip_' || key || '.mp4' AS clip_file,
               'temp_cropped_' || key || '.mp4' AS cropped_file, 'temp_subtitled_' || key || '.mp4' AS subtitled_file,
               CASE WHEN clip_status <> 'ok' THEN clip_status WHEN mode = 'reject' THEN 'too_narrow' ELSE 'planned' END AS status
        FROM (SELECT *, substr(sha256(video_id || '|' || clip_idx), 1, 8) AS key FROM many) c
        JOIN dims d ON d.video_id = c.video_id
        LEFT JOIN many_cropped x ON x.video_id = c.video_id AND x.clip_idx = c.clip_idx
        LEFT JOIN (SELECT video_id, clip_idx, count(*) AS k,
                          string_agg(first_frame || '-' || last_frame || '@' || crop_x, ';' ORDER BY range_no) AS plan
                   FROM many_clip_windows GROUP BY ALL) r ON r.video_id = c.video_id AND r.clip_idx = c.clip_idx
        LEFT JOIN many_captions n ON n.video_id = c.video_id AND n.clip_idx = c.clip_idx""",
    "clip_crop_ranges": "SELECT video_id, clip_idx, range_no, mode, first_frame, last_frame, crop_x, crop_x2 FROM clip_windows",
    "temp_file_names": """
        SELECT page_id, 'audio_' || k || '.wav' AS audio_file, 'temp_clip_' || k || '.mp4' AS clip_file,
               'temp_cropped_' || k || '.mp4' AS cropped_file, 'temp_subtitled_' || k || '.mp4' AS subtitled_file
        FROM (SELECT page_id, substr(sha256(page_id || '|' || title), 1, 8) AS k FROM titles)""",
    "chunk_audio": """
        SELECT doc_id AS video_id, i::INT AS frame_no, md5(unhex(substr(hex, i * 1920 + 1, 1920))) AS digest
        FROM (SELECT doc_id, hex, unnest(range(length(hex) // 1920)) AS i
              FROM (SELECT doc_id, hex(encode(text)) AS hex FROM documents))""",
    "export_channel": "SELECT DISTINCT url FROM channel WHERE tab IN ('videos', 'streams')",
    "slug": f"SELECT page_id, {_SLUG.format('title')} AS slug FROM titles",
    "safe_title": r"""
        SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(
                   title || ' a|b:c?*<d>"/\', '|', '-'), ':', '-'), '?', ''), '*', ''), '<', ''), '>', ''), '"', ''), '/', '-'), '\', '-') AS safe
        FROM titles""",
    "session_key": "SELECT video_id, substr(sha256(video_id || '|' || title), 1, 8) AS session FROM videos",
    "output_name": rf"""
        SELECT video_id, CASE WHEN t = '' THEN 'output' ELSE {_SLUG.format("t")} END || '_' || substr(sha256(video_id::VARCHAR), 1, 8)
               || '_short.mp4' AS output
        FROM (SELECT video_id, regexp_replace(title, '^\s+|\s+$', '', 'g') AS t FROM videos)""",
    "vertical_dims": """
        SELECT video_id, vw AS vertical_w, vh AS vertical_h, CASE WHEN width < vw THEN 'too_narrow' ELSE 'ok' END AS dims_status
        FROM dims""",
    "screen_scale": "SELECT video_id, scale, sw AS scaled_w, sh AS scaled_h, offset_y, max_x FROM scaled",
    "clamp_clip": "SELECT video_id, start_s, end_s, clip_s, clip_status FROM ranges",
    "gate_highlights": "SELECT video_id, start_s, stop_s FROM gated",
    "caption_layout": """
        SELECT video_id, seg_idx, start_s, end_s, trunc(vh * 0.065::DOUBLE)::INT AS font_size, vw - 100 AS box_width,
               '#2699ff' AS color, 'black' AS stroke_color, 2 AS stroke_width, 'Franklin-Gothic' AS font, 'center' AS pos_x,
               CASE WHEN seg_idx % 2 = 0 THEN vh - ceil(length(text) / 35)::INT * 40 - 100 END AS pos_y, end_s - start_s AS shown_s
        FROM captions JOIN dims USING (video_id) WHERE text IS NOT NULL""",
    "wrap_text": r"""
        SELECT video_id, seg_idx, CASE WHEN length(text) <= 35 THEN text ELSE array_to_string(list_reduce(
                   list_transform(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: [w]),
                   lambda acc, w: CASE WHEN length(acc[-1] || ' ' || w[1]) <= 35
                       THEN list_concat(acc[:-2], [acc[-1] || ' ' || w[1]]) ELSE list_concat(acc, w) END), chr(10)) END AS lines
        FROM segments""",
    "overlay_plan": "SELECT video_id, seg_idx, color, start_s, end_s FROM overlays",
    "merge_style": "SELECT video_id, seg_idx, "
    + " || ';' || ".join(
        [f"'{k}=' || {v}" for k, v in _STYLE.items() if k < "fade_duration"]
        + ["CASE WHEN seg_idx % 11 <> 6 THEN 'fade_duration=0.1;' ELSE '' END || 'font=DejaVu-Sans-Bold;fontsize=15'"]
        + ["'line_height=1.2;' || CASE WHEN seg_idx % 7 <> 4 THEN 'margin_bottom=100;' ELSE '' END || 'position=' || "
           + _STYLE["position"]]
        + [f"'{k}=' || {v}" for k, v in _STYLE.items() if k > "position"]
    )
    + " AS style FROM overlays",
    "overlay_style": """
        SELECT video_id, seg_idx, trunc(width * 0.8::DOUBLE)::INT AS box_width,
               CASE WHEN seg_idx % 3 <> 2 AND seg_idx % 11 <> 6 THEN least(0.1::DOUBLE, (end_s - start_s) / 2) END AS fade_s,
               CASE WHEN seg_idx % 3 <> 2 AND seg_idx % 7 <> 4 THEN height - 100 - 40 END AS pos_y, end_s - start_s AS shown_s,
               CASE WHEN seg_idx % 3 <> 2 AND (seg_idx % 11 = 6 OR seg_idx % 7 = 4) THEN 'missing_key' ELSE 'ok' END AS style_status
        FROM overlays JOIN videos USING (video_id)""",
    "scale_boxes": """
        SELECT video_id, frame_no, det_idx, confidence,
               trunc(x / 1920.0::DOUBLE * width)::INT AS x, trunc(y / 1080.0::DOUBLE * height)::INT AS y,
               trunc(x1 / 1920.0::DOUBLE * width)::INT AS x1, trunc(y1 / 1080.0::DOUBLE * height)::INT AS y1
        FROM dense JOIN videos USING (video_id) WHERE confidence > 0.3""",
    "lip_distance": "SELECT video_id, frame_no, det_idx, abs(y + floor(2 * (y1 - y) / 3)::INT - y1) AS lip FROM dense",
    "face_windows": "SELECT * FROM windows",
    "face_crop_windows": """
        SELECT video_id, frame_no, face_no, crop_x, crop_y, crop_x2, crop_y2 FROM frames JOIN windows USING (video_id)""",
    "render_prompt": f"""
        SELECT video_id, 'system' AS role, part_no AS piece_no,
               CASE WHEN part_no = 0 THEN '{PROMPT.replace("'", "''")}' ELSE '' END || transcript AS content FROM transcripts
        UNION ALL SELECT video_id, 'user', part_no, transcript FROM transcripts
        UNION ALL SELECT video_id, 'system', {LAST_PIECE}, chr(10) FROM transcripts WHERE part_no = 0""",
    "parse_highlight": "SELECT * FROM parsed",
    "transcript_stats": """
        SELECT video_id, n_segments, length(t) AS n_chars, substr(t, 1, 200) AS preview
        FROM (SELECT video_id, string_agg(transcript, '' ORDER BY part_no) AS t FROM transcripts GROUP BY 1)
        JOIN (SELECT video_id, count(*) AS n_segments FROM segments GROUP BY 1) USING (video_id)""",
    "discover": "SELECT url, tab, duration_s, view_count, upload_date FROM channel WHERE duration_s BETWEEN 900 AND 7200",
    "clip_captions": "SELECT * FROM captions",
    "zip_audio": "SELECT video_id, frame_no, is_speech FROM pairs",
    "crop_per_frame": "SELECT video_id, frame_no, smoothed_x FROM offsets",
    "first_answer": "SELECT prompt_id, user_id, answer, wait_us FROM answered",
    "approve": """
        SELECT prompt_id, user_id, CASE WHEN wait_us IS NULL THEN 'approve_timeout' WHEN lower(trim(answer)) = 'r' THEN 'regenerate'
               WHEN lower(trim(answer)) = 'n' THEN 'cancel' ELSE 'approve' END AS decision FROM answered""",
    "pending_items": """
        SELECT l_orderkey AS item_id, l_linenumber, l_partkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT item_id FROM run_state WHERE status IN ('success', 'failed'))""",
    "pending_items_with_retry": """
        SELECT l_orderkey AS item_id, l_linenumber, l_partkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT item_id FROM run_state WHERE status = 'success')""",
    "build_transcript": "SELECT video_id, part_no, transcript FROM transcripts",
    "largest_face": "SELECT video_id, frame_no, x, y, w, h, area FROM faces30",
    "clip_crops": "SELECT video_id, clip_idx, mode, x_start FROM cropped",
    "static_crop": "SELECT video_id, mode, x_start FROM crops",
    "motion_centroid": "SELECT video_id, sample_no, centroid_x FROM centroids",
    "active_speaker": "SELECT video_id, frame_no, lip, x, y, x1, y1, is_active FROM speakers",
    "unique_faces": "SELECT video_id, face_no, first_frame, x, y, w, h FROM faces",
    "outcome_funnel": "SELECT status, exit_code, count(*) AS n_items FROM outcomes GROUP BY ALL",
    "item_outcomes": "SELECT video_id, status, exit_code FROM outcomes",
    "settle_attempts": "SELECT * FROM settled",
    "batch_outcomes": """
        SELECT line_no, item, status, CASE WHEN status IN ('highlight_failed', 'crashed', 'out_of_range', 'too_narrow') THEN 1 ELSE 0 END AS exit_code
        FROM (SELECT d.doc_id AS line_no, 'https://example.org/watch/' || d.doc_id AS item, CASE
                  WHEN lang = 'es' THEN 'no_video' WHEN lang = 'fr' THEN 'no_audio' WHEN n IS NULL THEN 'no_transcript'
                  WHEN NOT coalesce(highlight_ok, false) THEN 'highlight_failed' WHEN decision = 'cancel' THEN 'cancelled'
                  WHEN decision = 'regenerate_failed' THEN 'crashed'
                  WHEN NOT (start_s > 0 AND stop_s > 0 AND stop_s > start_s) THEN 'bad_highlight'
                  WHEN start_s >= duration_s - 0.1::DOUBLE THEN 'out_of_range'
                  WHEN width < trunc(height * 9 / 16) - trunc(height * 9 / 16) % 2 THEN 'too_narrow' ELSE 'success' END AS status
              FROM documents d JOIN videos v ON v.video_id = d.doc_id LEFT JOIN settled s ON s.video_id = d.doc_id
              LEFT JOIN (SELECT video_id AS n FROM segments GROUP BY 1) ON n = d.doc_id)""",
    "many_clips": "SELECT * FROM many",
    "take_until": """
        SELECT line_no, success FROM (
            SELECT o_orderkey AS line_no, o_orderstatus = 'F' AS success,
                   sum((o_orderstatus = 'F')::INT) OVER (ORDER BY o_orderkey) - (o_orderstatus = 'F')::INT AS before FROM orders)
        WHERE before < 200""",
    "sentence_edges": "SELECT video_id, seg_idx, opens, closes FROM edges",
    "candidate_spans": "SELECT * FROM spans",
    "best_span": "SELECT video_id, first_idx, last_idx, start_s, end_s, span_s, score FROM scored WHERE turn = 1",
    "span_text": r"""
        SELECT s.video_id, first_idx, last_idx, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY seg_idx) AS content
        FROM scored s JOIN segments g ON g.video_id = s.video_id AND seg_idx BETWEEN first_idx AND last_idx WHERE turn = 1 GROUP BY ALL""",
    "all_spans": "SELECT video_id, unnest(kept, recursive := true) FROM greedy",
    "fill_track": """
        SELECT video_id, frame_no, last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y,
               last_value(x1 IGNORE NULLS) OVER w AS x1, last_value(y1 IGNORE NULLS) OVER w AS y1
        FROM speakers WINDOW w AS (PARTITION BY video_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING)""",
    "smooth_track": "SELECT video_id, sample_no, smoothed_x FROM smoothed",
    "crop_window": """
        SELECT video_id, frame_no, CASE WHEN e - smoothed_x < vw THEN greatest(0, e - vw) ELSE smoothed_x END AS crop_x, e AS crop_x2
        FROM (SELECT video_id, frame_no, smoothed_x, vw, least(smoothed_x + vw, sw) AS e FROM offsets JOIN scaled USING (video_id))""",
    "sample_frames": """
        SELECT video_id, frame_no, floor(frame_no / trunc(fps))::INT AS sample_no FROM frames JOIN videos USING (video_id)
        WHERE frame_no % trunc(fps) = 0""",
    "nms": """
        SELECT video_id, frame_no, i - 1 AS rank, kept[i].det_idx AS det_idx, kept[i].confidence AS confidence,
               kept[i].x AS x, kept[i].y AS y, kept[i].x1 AS x1, kept[i].y1 AS y1
        FROM (SELECT *, unnest(range(1, least(len(kept), 200) + 1)) AS i FROM nms_kept)""",
}

# A stream run to its end gives what the batch form gives.
QUERIES_SQL["approve_stream"] = QUERIES_SQL["approve"]
QUERIES_SQL["smooth_stream"] = QUERIES_SQL["smooth_track"]
QUERIES_SQL["smooth_stream_with_losses"] = "SELECT video_id, sample_no, smoothed_x FROM kept_smoothed"
QUERIES_SQL["route_inputs_from_storage"] = """
    SELECT s_suppkey AS line_no, '/videos/nation=' || s_nationkey AS item,
           CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) THEN 'file' ELSE 'url' END AS route FROM supplier"""
QUERIES_SQL["read_work_list"] = "SELECT url AS item FROM pages"
QUERIES_SQL["read_segment_files"] = QUERIES_SQL["read_segments"]
QUERIES_SQL["plan_sink"] = """
    SELECT video_id, status, exit_code, CASE WHEN status = 'success' THEN 'run-2' ELSE 'run-1' END AS run_id FROM outcomes"""
QUERIES_SQL["unattended_run"] = """
    SELECT video_id AS line_no, video_id::VARCHAR AS item_id, CASE WHEN status = 'success' THEN 'success' ELSE 'failed' END AS status, status AS outcome
    FROM (SELECT *, coalesce(sum((status = 'success')::INT) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM outcomes) WHERE before < 20"""
QUERIES_SQL["items_stream_runs"] = """
    SELECT item AS item_id, CASE WHEN outcome = 'success' THEN 'success' ELSE 'failed' END AS status, outcome, version::BIGINT AS version
    FROM (SELECT item, min(line_no // 2 % 2) AS version FROM items GROUP BY 1)
    JOIN (SELECT url, min(CASE page_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'crashed' ELSE 'no_audio' END) AS outcome FROM pages GROUP BY 1)
      ON url = item"""
# Nobody is asked about a reply that failed, so nothing but approval can stand beside it.
QUERIES_SQL["settle_stream"] = """
    SELECT video_id, attempt, start_s, stop_s, highlight_ok, CASE WHEN highlight_ok THEN decision ELSE 'approve' END AS decision
    FROM settled WHERE video_id IN (SELECT doc_id FROM documents)"""
QUERIES_SQL["face_crop_ranges"] = """
    SELECT video_id, face_no, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS n_frames, crop_x, crop_y, crop_x2, crop_y2
    FROM frames JOIN windows USING (video_id) GROUP BY ALL"""
# Sound in parts gives the frames of the whole.
QUERIES_SQL["chunk_audio_parts"] = QUERIES_SQL["chunk_audio"]
QUERIES_SQL["items_stream"] = """
    SELECT item AS item_id FROM items
    WHERE item NOT IN (SELECT url FROM pages WHERE page_id % 3 < 2)"""

ORACLES: dict[str, str] = {name: _with(sql) for name, sql in QUERIES_SQL.items()}
