"""Sample searches on the read catalog `data`.

Written so that no window or join meets an unbounded group: windows run over
distinct versions (at most 999) or distinct frames (at most 10,000) of a key,
and joins meet on keys that are unique on one side.
"""

SEARCHES = {
    "search_filter": """
        SELECT filepath, project, version, frame FROM data
        WHERE specification == 'spec001' AND asset_valid AND version > 500""",
    "search_group_by": """
        SELECT project, specification, count(*) AS n_files,
               sum(CASE WHEN asset_valid THEN 1 ELSE 0 END) AS n_valid,
               min(version) AS min_version, max(version) AS max_version,
               avg(frame) AS avg_frame
        FROM data WHERE project IS NOT NULL GROUP BY project, specification""",
    "search_having": """
        SELECT asset_path, count(*) AS n_files FROM data
        WHERE asset_path IS NOT NULL GROUP BY asset_path HAVING count(*) > 4""",
    "search_distinct": """
        SELECT DISTINCT project, descriptor, extension FROM data""",
    "search_latest_version": """
        SELECT project, descriptor, version, n_files FROM (
            SELECT project, descriptor, version, n_files,
                   row_number() OVER (PARTITION BY project, descriptor
                                      ORDER BY version DESC) AS place
            FROM (SELECT project, descriptor, version, count(*) AS n_files FROM data
                  WHERE asset_valid GROUP BY project, descriptor, version) v) r
        WHERE place = 1""",
    "search_frame_gaps": """
        SELECT asset_path, frame, previous_frame, frame - previous_frame AS gap FROM (
            SELECT asset_path, frame, lag(frame) OVER (PARTITION BY asset_path
                                                       ORDER BY frame) AS previous_frame
            FROM (SELECT DISTINCT asset_path, frame FROM data
                  WHERE frame IS NOT NULL) d) g
        WHERE previous_frame IS NOT NULL AND frame - previous_frame > 1""",
    "search_running_count": """
        SELECT project, version, n_files,
               sum(n_files) OVER (PARTITION BY project ORDER BY version
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
        FROM (SELECT project, version, count(*) AS n_files FROM data
              WHERE version IS NOT NULL GROUP BY project, version) v""",
    "search_self_join": """
        SELECT a.project, a.descriptor, a.version, b.version AS next_version
        FROM (SELECT DISTINCT project, descriptor, version FROM data
              WHERE version IS NOT NULL) a
        JOIN (SELECT DISTINCT project, descriptor, version FROM data
              WHERE version IS NOT NULL) b
          ON a.project = b.project AND a.descriptor = b.descriptor
         AND a.version + 25 = b.version""",
    "search_left_join": """
        SELECT f.filepath, a.n_errors
        FROM data f LEFT JOIN (
            SELECT asset_path, count(*) AS n_errors FROM data
            WHERE file_error IS NOT NULL AND asset_path IS NOT NULL
            GROUP BY asset_path) a
          ON f.asset_path = a.asset_path
        WHERE f.frame IS NOT NULL""",
    "search_top_k": """
        SELECT filepath, frame FROM data WHERE asset_valid AND frame IS NOT NULL
        ORDER BY frame DESC, filepath LIMIT 20 OFFSET 5""",
    "search_union": """
        SELECT project, descriptor FROM data WHERE specification = 'spec001'
        UNION
        SELECT project, descriptor FROM data WHERE specification = 'vdb001'""",
    "search_intersect": """
        SELECT descriptor FROM data WHERE specification = 'spec001'
        INTERSECT
        SELECT descriptor FROM data WHERE specification = 'spec002'""",
    "search_except": """
        SELECT project, version FROM data WHERE specification = 'spec001'
        EXCEPT
        SELECT project, version FROM data WHERE specification = 'spec002'""",
    "search_scalar": """
        SELECT filepath, upper(project) AS project_upper, length(filename) AS name_length,
               replace(filename, '_', '-') AS dashed, substr(filename, 1, 9) AS head,
               coalesce(descriptor, 'none') AS descriptor_or_none,
               version * 2 + 1 AS odd, frame % 7 AS frame_mod,
               CASE WHEN asset_valid THEN 'valid' ELSE 'invalid' END AS state,
               filename LIKE 'p-proj00%' AS low_project
        FROM data""",
}

# A common table expression, and lists in one text: the dialects differ here.
CTE_SEARCH = """
    {lead} per_asset AS (
        SELECT asset_path, count(*) AS n FROM data
        WHERE asset_path IS NOT NULL GROUP BY asset_path)
    SELECT n, count(*) AS n_assets FROM per_asset GROUP BY n"""
GROUP_CONCAT_SEARCH = """
    SELECT project, descriptor, count(*) AS n_versions,
           {list} AS versions
    FROM (SELECT DISTINCT project, descriptor, version FROM data
          WHERE version IS NOT NULL) v
    GROUP BY project, descriptor"""
SPARK_LIST = "listagg(cast(version AS string), ',') WITHIN GROUP (ORDER BY cast(version AS string))"
# Folders above the assets, from each up to the root, with the assets below: sums per folder go up,
# not assets.
RECURSIVE_SEARCH = """
    {lead} folders(folder, n_assets, height) AS (
        SELECT regexp_extract(asset_path, '^(.*)/[^/]+$', 1), count(DISTINCT asset_path), 1 FROM data
        WHERE asset_path IS NOT NULL GROUP BY regexp_extract(asset_path, '^(.*)/[^/]+$', 1)
        UNION ALL
        SELECT regexp_extract(folder, '^(.*)/[^/]+$', 1), n_assets, height + 1 FROM folders
        WHERE folder <> '')
    SELECT folder, CAST(sum(n_assets) AS BIGINT) AS n_assets, max(height) AS height
    FROM folders GROUP BY folder"""
