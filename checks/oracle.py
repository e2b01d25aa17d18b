"""The queries again, as DuckDB SQL over the same tables.

Written from the meaning of each operator, not from the Spark plans: names are
parsed by plain regexes, asset errors by one aggregate with lists.
"""

from __future__ import annotations

from assetry.plans.searches import CTE_SEARCH, GROUP_CONCAT_SEARCH, RECURSIVE_SEARCH, SEARCHES

# --- the listing -------------------------------------------------------------

_LISTING = """
keys AS (
    SELECT DISTINCT l_orderkey AS ok, l_linenumber AS ln,
           CAST(l_partkey % 1000 AS INTEGER) AS pk
    FROM lineitem),
facts AS (
    SELECT ok, ln, pk, pk % 50 AS bad,
           ['spec001', 'spec001', 'spec001', 'spec002', 'spec002', 'vdb001',
            'raw009', 'none'][ok % 8 + 1] AS spec,
           ['png', 'png', 'png', 'jpg', 'jpg', 'vdb', 'jpg', 'txt'][ok % 8 + 1] AS extension,
           'proj' || lpad(CAST(ok % 25 + 1 AS VARCHAR), 3, '0') AS proj,
           ['pizza', 'taco', 'kiwi', 'bagel'][ok % 4 + 1] AS descr,
           lpad(CAST(CASE WHEN ok % 8 = 5 THEN ln ELSE ok % 999 + 1 END AS VARCHAR), 3, '0') AS ver
    FROM keys),
names AS (
    SELECT *,
        '/ingress/' || proj || '/' || spec || '/o' || ok || CASE
            WHEN spec = 'none' THEN ''
            WHEN spec = 'vdb001' THEN '/k' || pk
            ELSE '/p-' || proj || '_s-' || spec || '_d-' || descr || '_v' || ver END AS directory,
        CASE WHEN spec = 'none' THEN 'misc_' || ln || '_' || pk ELSE
            'p-' || proj || '_s-' || spec || CASE WHEN bad = 3 THEN '2' ELSE '' END
            || '_d-' || CASE WHEN bad = 0 THEN upper(descr) WHEN bad = 2 THEN 'other' ELSE descr END
            || '_v' || CASE WHEN bad = 1 THEN substr(ver, 2) ELSE ver END
            || CASE WHEN spec = 'spec001' THEN '_c000' || (pk % 2) || '-000' || (ok % 3) ELSE '' END
            || CASE WHEN spec = 'vdb001' THEN ''
                    ELSE CASE WHEN bad = 4 THEN '_g' ELSE '_f' END || (ln * 1000 + pk) END
        END || '.' || extension AS filename,
        spec IN ('spec001', 'spec002', 'raw009') AS is_image
    FROM facts),
listing AS (
    SELECT ok, ln, pk, directory || '/' || filename AS filepath, filename, extension,
           CASE WHEN is_image THEN CASE WHEN pk % 41 = 0 THEN 400 ELSE 4 END END AS width,
           CASE WHEN is_image THEN 5 END AS height,
           CASE WHEN is_image THEN 3 END AS channels
    FROM names)"""

# --- names -------------------------------------------------------------------

_TOKEN = {
    "project": ("p-", "[a-z]{3,10}[0-9]{1,4}"),
    "specification": ("s-", "[a-z]{3,4}[0-9]{3}"),
    "descriptor": ("d-", "[a-z0-9][a-z0-9-]*"),
    "version": ("v", "[0-9]{3}"),
    "coordinate": ("c", "[0-9]{4}(-[0-9]{4}){0,2}"),
    "frame": ("f", "[0-9]{4}"),
    "extension": ("[.]", "[a-zA-Z0-9]+"),
}
_BASE = ["project", "specification", "descriptor", "version"]
_LAYOUTS = {
    "spec001": [*_BASE, "coordinate", "frame", "extension"],
    "spec002": [*_BASE, "frame", "extension"],
    "vdb001": [*_BASE, "extension"],
}


def _error_case(fields: list[str]) -> str:
    """CASE over ever longer prefixes: the first one that fails names the part."""
    whens, prefix = [], "^"
    for i, field in enumerate(fields):
        indicator, token = _TOKEN[field]
        if i and field != "extension":
            prefix += "_"
            whens.append((prefix, "Expected ''_''"))
        prefix += indicator
        whens.append((prefix, f"Illegal {field} field indicator"))
        prefix += token
        whens.append((prefix + ("$" if field == "extension" else ""), f"Illegal {field} field token"))
    body = " ".join(
        f"WHEN NOT regexp_matches(filename, '{rx}') THEN '{msg} in \"' || filename || '\".'"
        for rx, msg in whens
    )
    return f"CASE {body} END"


_ERRORS = " ".join(f"WHEN '{s}' THEN {_error_case(f)}" for s, f in _LAYOUTS.items())

_FILES = f"""
tokens AS (
    SELECT *, CASE WHEN instr(filename, 's-') > 0 THEN nullif(regexp_extract(
        substr(filename, instr(filename, 's-') + 2),
        '^([a-z]{{3,4}}[0-9]{{3}})(?:$|[^0-9])', 1), '') END AS specification
    FROM listing),
errors AS (
    SELECT *, specification IS NOT NULL AND specification IN ('spec001', 'spec002', 'vdb001') AS known,
           CASE specification {_ERRORS} END AS filename_error
    FROM tokens),
parsed AS (
    SELECT *, known AND filename_error IS NULL AS good,
        CASE WHEN specification IN ('spec001', 'spec002')
             THEN regexp_extract(filepath, '^(.*)/[^/]+$', 1)
             WHEN specification = 'vdb001' THEN filepath END AS asset_path,
        CASE WHEN specification IN ('spec001', 'spec002') THEN 'sequence'
             WHEN specification = 'vdb001' THEN 'file' END AS asset_type
    FROM errors),
fields AS (
    SELECT *,
        CASE WHEN good THEN regexp_extract(filename, '^p-([^_]+)', 1) END AS project,
        CASE WHEN good THEN regexp_extract(filename, '_d-([^_.]+)', 1) END AS descriptor,
        CASE WHEN good THEN CAST(regexp_extract(filename, '_v([0-9]{{3}})', 1) AS INTEGER) END AS version,
        CASE WHEN good AND specification = 'spec001'
             THEN CAST(regexp_extract(filename, '_c([0-9]{{4}})', 1) AS INTEGER) END AS cx,
        CASE WHEN good AND specification = 'spec001'
             THEN CAST(regexp_extract(filename, '_c[0-9]{{4}}-([0-9]{{4}})', 1) AS INTEGER) END AS cy,
        CASE WHEN good AND specification <> 'vdb001'
             THEN CAST(regexp_extract(filename, '_f([0-9]{{4}})', 1) AS INTEGER) END AS frame,
        CASE WHEN good THEN regexp_extract(filename, '[.]([^.]+)$', 1) END AS name_extension,
        CASE WHEN known THEN width END AS trait_width,
        CASE WHEN known THEN height END AS trait_height,
        CASE WHEN known THEN channels END AS trait_channels
    FROM parsed),
named AS (
    SELECT *, CASE WHEN good THEN 'p-' || project || '_s-' || specification || '_d-' || descriptor
        || '_v' || lpad(CAST(version AS VARCHAR), 3, '0') END AS expected_name,
        regexp_extract(asset_path, '([^/]+)$', 1) AS directory_name,
        CASE WHEN known THEN '{{' || concat_ws(',',
            CASE WHEN good THEN '"project":"' || project || '"' END,
            CASE WHEN good THEN '"specification":"' || specification || '"' END,
            CASE WHEN good THEN '"descriptor":"' || descriptor || '"' END,
            '"version":' || version,
            CASE WHEN cx IS NOT NULL THEN '"coordinate":[' || cx || ',' || cy || ']' END,
            '"frame":' || frame,
            '"extension":"' || name_extension || '"',
            '"width":' || trait_width,
            '"height":' || trait_height,
            '"channels":' || trait_channels,
            '"filename_error":' || CAST(to_json(filename_error) AS VARCHAR)) || '}}' END AS file_traits
    FROM fields),
files AS (
    SELECT *,
        CASE WHEN specification IS NULL THEN 'Specification not found in "' || filename || '".'
             WHEN NOT known THEN 'KeyError( Specification not found. )'
             WHEN filename_error IS NOT NULL THEN 'ValidationError( ' || filename_error || ' )'
             WHEN asset_type <> 'file' AND directory_name <> expected_name
             THEN 'ValidationError( Invalid asset directory name. Expecting: ' || expected_name
                  || '. Found: ' || directory_name || ' in ' || filepath || '. )'
        END AS file_error,
        substr(filepath, 10) AS filepath_relative,
        substr(asset_path, 10) AS asset_path_relative
    FROM named),
rows AS (
    SELECT *, CASE WHEN file_error IS NULL THEN expected_name END AS asset_name FROM files)"""

_ASSETS = """
problems AS (
    SELECT asset_path, specification, count(*) AS n_files, count(file_error) AS n_file_errors,
        list_sort(list_filter([
            CASE WHEN count(filename_error) > 0 THEN 'filename_error: Rogue field.' END,
            CASE WHEN count(name_extension) = 0 THEN 'extension: This field is required.' END,
            CASE WHEN specification <> 'vdb001' AND count(frame) = 0
                 THEN 'frame: This field is required.' END,
            CASE WHEN specification = 'spec001' AND count(cx) = 0
                 THEN 'coordinate: This field is required.' END,
            CASE WHEN specification <> 'vdb001' AND max(trait_width) > 4
                 THEN 'width: ' || arg_min(trait_width, filepath) FILTER (WHERE trait_width <> 4)
                      || ' != 4.' END
        ], lambda x: x IS NOT NULL)) AS texts
    FROM rows WHERE asset_path IS NOT NULL GROUP BY asset_path, specification),
assets AS (
    SELECT asset_path, specification, n_files, n_file_errors,
        CASE WHEN len(texts) > 0 THEN 'DataError( ' || array_to_string(texts, ' ') || ' )' END AS asset_error
    FROM problems),
catalog AS (
    SELECT r.*, a.asset_error,
           r.known AND r.file_error IS NULL AND a.asset_error IS NULL AS asset_valid
    FROM rows r LEFT JOIN assets a ON r.asset_path = a.asset_path)"""


def _uuid(text: str) -> str:
    h = f"md5(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({text}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-3' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1) || "
        f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


_PUBLISH = f"""
valid AS (
    SELECT *, {_uuid('asset_path')} AS asset_id, {_uuid('filepath')} AS file_id,
           '/staging/content/' || asset_path_relative AS staged_asset,
           '/staging/content/' || filepath_relative AS staged_file
    FROM catalog WHERE asset_valid),
file_docs AS (
    SELECT asset_id, staged_asset AS asset_path, asset_path_relative, asset_name, asset_type,
           file_id, file_traits, filename, staged_file AS filepath, filepath_relative
    FROM valid),
places AS (
    SELECT filepath, (row_number() OVER (PARTITION BY asset_path ORDER BY filepath) - 1) // 4 AS part,
           CAST(ceil(count(*) OVER (PARTITION BY asset_path) / 4) AS BIGINT) AS n_parts
    FROM rows WHERE asset_path IS NOT NULL),
trait_lists AS (
    SELECT asset_path, part, n_parts, '{{' || concat_ws(',',
        '"project":' || CAST(to_json(list(project ORDER BY filepath) FILTER (WHERE project IS NOT NULL)) AS VARCHAR),
        CASE WHEN count(project) > 0 THEN '"specification":' || CAST(to_json(list(specification ORDER BY filepath) FILTER (WHERE good)) AS VARCHAR) END,
        '"descriptor":' || CAST(to_json(list(descriptor ORDER BY filepath) FILTER (WHERE descriptor IS NOT NULL)) AS VARCHAR),
        '"version":' || CAST(to_json(list(version ORDER BY filepath) FILTER (WHERE version IS NOT NULL)) AS VARCHAR),
        '"coordinate":' || CAST(to_json(list([cx, cy] ORDER BY filepath) FILTER (WHERE cx IS NOT NULL)) AS VARCHAR),
        '"frame":' || CAST(to_json(list(frame ORDER BY filepath) FILTER (WHERE frame IS NOT NULL)) AS VARCHAR),
        '"extension":' || CAST(to_json(list(name_extension ORDER BY filepath) FILTER (WHERE name_extension IS NOT NULL)) AS VARCHAR),
        '"width":' || CAST(to_json(list(trait_width ORDER BY filepath) FILTER (WHERE trait_width IS NOT NULL)) AS VARCHAR),
        '"height":' || CAST(to_json(list(trait_height ORDER BY filepath) FILTER (WHERE trait_height IS NOT NULL)) AS VARCHAR),
        '"channels":' || CAST(to_json(list(trait_channels ORDER BY filepath) FILTER (WHERE trait_channels IS NOT NULL)) AS VARCHAR)
        ) || '}}' AS asset_traits
    FROM rows JOIN places USING (filepath) GROUP BY asset_path, part, n_parts),
heads AS (
    SELECT asset_id, asset_path, staged_asset, asset_path_relative, asset_type,
           arg_min(asset_name, filepath) AS asset_name
    FROM valid GROUP BY asset_id, asset_path, staged_asset, asset_path_relative, asset_type),
asset_lists AS (
    SELECT asset_path, part, list(file_id ORDER BY filepath) AS file_ids, list(filename ORDER BY filepath) AS filenames,
           list(filepath ORDER BY filepath) AS filepaths,
           list(filepath_relative ORDER BY filepath) AS filepaths_relative
    FROM valid JOIN places USING (filepath) GROUP BY asset_path, part),
asset_docs AS (
    SELECT h.*, t.part, t.n_parts, t.asset_traits, coalesce(file_ids, []) AS file_ids,
           coalesce(filenames, []) AS filenames, coalesce(filepaths, []) AS filepaths,
           coalesce(filepaths_relative, []) AS filepaths_relative
    FROM heads h JOIN trait_lists t USING (asset_path) LEFT JOIN asset_lists l USING (asset_path, part))"""

_DATA = """
data AS (
    SELECT project, specification, descriptor, version, cx AS coordinate_x, cy AS coordinate_y,
           CAST(NULL AS INTEGER) AS coordinate_z, frame, extension, filename, filepath, file_error,
           asset_name, asset_path, asset_type, asset_error, asset_valid, asset_path_relative,
           trait_channels AS channels, filename_error, filepath_relative,
           trait_height AS height, trait_width AS width
    FROM catalog)"""

_POINTS = """
points AS (
    SELECT ok, ln, CAST(ln % 3 AS INTEGER) AS x, CAST(pk % 2 AS INTEGER) AS y FROM keys)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


LISTING = _with(_LISTING)
ROWS = _with(_LISTING, _FILES)
CATALOG = _with(_LISTING, _FILES, _ASSETS)
PUBLISH = _with(_LISTING, _FILES, _ASSETS, _PUBLISH)
DATA = _with(_LISTING, _FILES, _ASSETS, _DATA)
POINTS = _with(_LISTING, _POINTS)

_FILE_JSON = """'{"asset_id":"' || asset_id || '","asset_path":"' || asset_path
    || '","asset_path_relative":"' || asset_path_relative || '","asset_name":"' || asset_name
    || '","asset_type":"' || asset_type || '","file_id":"' || file_id || '","file_traits":'
    || file_traits || ',"filename":"' || filename || '","filepath":"' || filepath
    || '","filepath_relative":"' || filepath_relative || '"}'"""
_ASSET_JSON = """'{"asset_id":"' || asset_id || '","asset_path":"' || staged_asset
    || '","asset_path_relative":"' || asset_path_relative || '","asset_name":"' || asset_name
    || '","asset_traits":' || asset_traits || ',"asset_type":"' || asset_type
    || '","file_ids":' || CAST(to_json(file_ids) AS VARCHAR)
    || ',"filenames":' || CAST(to_json(filenames) AS VARCHAR)
    || ',"filepaths":' || CAST(to_json(filepaths) AS VARCHAR)
    || ',"filepaths_relative":' || CAST(to_json(filepaths_relative) AS VARCHAR)
    || ',"part":' || part || ',"n_parts":' || n_parts || '}'"""


def _ancestors(source: str, column: str, first: int = 2) -> str:
    """Every directory above (and at) the paths of a table, once."""
    return f"""SELECT DISTINCT array_to_string(parts[1:n], '/') AS directory FROM (
        SELECT parts, unnest(range({first}, len(parts) + 1)) AS n FROM (
            SELECT DISTINCT string_split({column}, '/') AS parts FROM {source}))"""


_PARENT = "regexp_extract(filepath, '^(.*)/[^/]+$', 1)"


def _each(value: str, fails: str, message: str) -> str:
    return f"""{LISTING}, judged AS (
        SELECT ok, filepath, v, v IS NOT NULL AND NOT coalesce({fails}, false) AS failed
        FROM (SELECT ok, filepath, ({value}) AS v FROM (SELECT * FROM listing)))
    SELECT ok, count(v) AS n_values, count(*) FILTER (WHERE failed) AS n_failed,
           arg_min({message}, filepath) FILTER (WHERE failed) AS first_failure
    FROM judged GROUP BY ok"""


def _choice(values: str, index: str) -> str:
    return f"{values}[{index} + 1]"


_WORDS = "['pizza', 'master-pizza', 'final', 'last1', 'Kiwi', 'taco_1', 'a-b', '-x', '']"
_PROJECTS = "['proj', 'pr', 'project', 'abcdefghijk', 'Proj', 'pro-j', 'p1x']"
_EXTENSIONS = "['png', 'PNG', 'jpg', 'j-g', 'vdb', '']"


def _named(text: str, what: str) -> str:
    return f"'\"' || v || '\" is not a valid {what}.'"


_PROGRESS = """
    SELECT event_id, user_id AS name, ts AS created,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS step,
           CASE WHEN event_id % 10 = 0 THEN 0 ELSE 100 END AS total, event_type
    FROM events"""
_PROGRESS_COLUMNS = """CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE step / total::DOUBLE END AS progress,
    'Progress: ' || printf('%.2f', CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE step / total::DOUBLE END * 100)
    || '% (' || step || ' of ' || total || ') - ' || event_type AS message"""

_CATALOG_COLUMNS = """specification, extension, filename, filepath, file_error, file_traits,
    asset_name, asset_path, asset_type"""

ORACLE: dict[str, str] = {
    "listing_columns": f"{LISTING} SELECT filepath, filename, extension FROM listing",
    "scan_directories": f"{LISTING}, parents AS (SELECT {_PARENT} AS d FROM listing) "
    + _ancestors("parents", "d"),
    "filter_include": f"{LISTING} SELECT filepath FROM listing "
    "WHERE regexp_matches(filepath, '/spec00[12]/.*_v1')",
    "filter_exclude": f"{LISTING} SELECT filepath FROM listing "
    "WHERE NOT regexp_matches(filepath, 'misc|/raw')",
    "filter_include_exclude": f"{LISTING} SELECT filepath FROM listing "
    "WHERE regexp_matches(filepath, 'proj01[0-9]') AND NOT regexp_matches(filepath, '[.]png$')",
    "file_metadata": f"{PUBLISH} SELECT * FROM file_docs",
    "file_chunk": f"{PUBLISH} SELECT {_FILE_JSON} AS value FROM file_docs",
    "asset_metadata": f"""{PUBLISH} SELECT asset_id, staged_asset AS asset_path, asset_path_relative,
        asset_name, asset_traits, asset_type, array_to_string(file_ids, ',') AS file_ids,
        array_to_string(filenames, ',') AS filenames, array_to_string(filepaths, ',') AS filepaths,
        array_to_string(filepaths_relative, ',') AS filepaths_relative, part, n_parts
        FROM asset_docs""",
    "asset_chunk": f"{PUBLISH} SELECT {_ASSET_JSON} AS value FROM asset_docs",
    "metadata_by_type": f"""{PUBLISH}
        SELECT 'file' AS metadata_type, file_id AS id, CAST(0 AS BIGINT) AS part,
               sha256({_FILE_JSON}) AS value_sha256 FROM file_docs
        UNION ALL SELECT 'asset', asset_id, part, sha256({_ASSET_JSON}) FROM asset_docs""",
    "export_content_manifest": f"""{PUBLISH} SELECT filepath AS source,
        '/export/content/' || filepath_relative AS target FROM file_docs""",
    "copy_plan": f"{PUBLISH} SELECT filepath AS source, staged_file AS target FROM valid",
    "export_object_keys": f"""{PUBLISH}
        SELECT 'content' AS kind, 'catalog/content/' || filepath_relative AS object_key,
               staged_file AS source FROM valid
        UNION ALL SELECT 'file', 'catalog/metadata/file/' || file_id || '.json',
               '/staging/metadata/file/' || file_id || '.json' FROM valid
        UNION ALL SELECT 'asset', 'catalog/metadata/asset/' || name, '/staging/metadata/asset/' || name
        FROM (SELECT asset_id || CASE WHEN part > 0 THEN '.' || part ELSE '' END || '.json' AS name
              FROM asset_docs)""",
    "export_folders": f"""{PUBLISH}, held AS (
            SELECT '/' || regexp_extract(filepath_relative, '^(.*)/[^/]+$', 1) AS d FROM valid),
        every AS ({_ancestors("held", "d")}),
        tops AS (SELECT DISTINCT '/' || asset_path_relative AS directory, asset_id FROM valid
                 WHERE asset_type <> 'file')
        SELECT e.directory AS folder, regexp_extract(e.directory, '([^/]+)$', 1) AS name,
               coalesce(nullif(regexp_extract(e.directory, '^(.*)/[^/]+$', 1), ''), '/') AS parent_folder,
               t.asset_id
        FROM every e LEFT JOIN tops t USING (directory)""",
    "export_items": f"""{PUBLISH} SELECT file_id, filename AS name,
        '/' || regexp_extract(filepath_relative, '^(.*)/[^/]+$', 1) AS parent_folder,
        filepath AS source FROM valid""",
    "staging_missing": f"""{PUBLISH}, written AS (
            SELECT regexp_extract(staged_file, '^(.*)/[^/]+$', 1) AS d FROM valid
            UNION ALL SELECT '/staging/metadata/file' FROM valid),
        seen AS ({_ancestors("written", "d")})
        SELECT directory FROM (VALUES ('/staging/content'), ('/staging/metadata'),
            ('/staging/metadata/asset'), ('/staging/metadata/file'),
            ('/staging/metadata/asset-chunk'), ('/staging/metadata/file-chunk')) AS t(directory)
        WHERE directory NOT IN (SELECT directory FROM seen)""",
    "empty_directories": f"""{LISTING}, parents AS (SELECT {_PARENT} AS d FROM listing),
        used AS (SELECT {_PARENT} AS d FROM listing WHERE pk % 50 >= 20),
        every AS ({_ancestors("parents", "d")}), full_ones AS ({_ancestors("used", "d")})
        SELECT directory FROM every WHERE directory NOT IN (SELECT directory FROM full_ones)""",
    "progress_latest": f"""WITH log AS ({_PROGRESS})
        SELECT name, step, total, {_PROGRESS_COLUMNS.split("AS progress,")[1]}
        FROM log QUALIFY row_number() OVER (PARTITION BY name ORDER BY created DESC, event_id DESC) = 1""",
    "progress_message": f"WITH log AS ({_PROGRESS}) SELECT event_id, {_PROGRESS_COLUMNS} FROM log",
    "cond_column": f"""{LISTING} SELECT filepath, CASE WHEN width > 100 THEN 'wide ' || width
        ELSE coalesce(CAST(width AS VARCHAR), 'no image') END AS size_class FROM listing""",
    "add_specification": f"""{ROWS} SELECT filepath, specification,
        CASE WHEN specification IS NULL OR NOT known THEN file_error END AS file_error FROM rows""",
    "spec_not_found": f"""{ROWS} SELECT filepath, specification, file_error FROM rows
        WHERE specification IS NOT NULL AND NOT known""",
    "parse_filename": f"""{ROWS} SELECT filepath, project,
        CASE WHEN good THEN specification END AS specification, descriptor, version,
        CASE WHEN cx IS NOT NULL THEN cx || ',' || cy END AS coordinate, frame,
        name_extension AS extension FROM rows""",
    "format_name": f"{ROWS} SELECT filepath, CASE WHEN good THEN filename END AS name FROM rows",
    "parse_extension": f"""{LISTING} SELECT filepath, extension,
        regexp_extract(filename, '([a-zA-Z0-9]+)$', 1) AS parsed_extension FROM listing""",
    "filename_error": f"{ROWS} SELECT filepath, filename_error FROM rows",
    "validate_filepath": f"{ROWS} SELECT filepath, file_error FROM rows",
    "file_traits": f"{ROWS} SELECT filepath, file_traits FROM rows",
    "user_traits": f"""{ROWS} SELECT filepath,
        CASE WHEN specification = 'vdb001' THEN
            CAST(length(filepath) - length(replace(filepath, '/', '')) AS INTEGER) END AS depth,
        CASE WHEN specification IN ('vdb001', 'spec002') AND NOT contains(filepath, '_v0')
             THEN CAST(ok AS INTEGER) END AS order_number,
        CASE WHEN specification IN ('vdb001', 'spec002') AND contains(filepath, '_v0')
             THEN 'ValueError( version below 100 )' END AS order_error
        FROM rows""",
    "image_traits": f"""{LISTING} SELECT filepath, width, height, channels,
        CASE WHEN width IS NULL THEN 'ValueError( Not a PNG or JPEG image. )' END AS image_error
        FROM listing""",
    "relative_path": f"""{LISTING} SELECT substr(filepath, 10) AS filepath_relative,
        CASE WHEN starts_with(filepath, '/ingress/proj001/') THEN substr(filepath, 18)
             ELSE filepath END AS below_project FROM listing""",
    "asset_name": f"{ROWS} SELECT filepath, asset_name FROM rows",
    "asset_path": f"{ROWS} SELECT filepath, asset_path, asset_path_relative FROM rows",
    "asset_type": f"{ROWS} SELECT filepath, asset_type FROM rows",
    "asset_id": f"""{ROWS} SELECT filepath,
        CASE WHEN file_error IS NULL THEN {_uuid('asset_path')} END AS asset_id FROM rows""",
    "asset_valid": f"{CATALOG} SELECT filepath, asset_valid FROM catalog",
    "cleanup": f"""{ROWS} SELECT {_CATALOG_COLUMNS}, CAST(NULL AS VARCHAR) AS asset_traits,
        CAST(NULL AS VARCHAR) AS asset_error, CAST(NULL AS BOOLEAN) AS asset_valid,
        asset_path_relative, filepath_relative FROM rows""",
    "read_files": f"{DATA} SELECT * FROM data",
    "read_scalar_columns": f"""{CATALOG} SELECT specification, extension, filename, filepath,
        file_error, asset_name, asset_path, asset_type, asset_error, asset_valid,
        asset_path_relative, filepath_relative FROM catalog""",
    "valid_files": f"{CATALOG} SELECT filepath, asset_path FROM catalog WHERE asset_valid",
    "expand_filepaths": f"""{LISTING} SELECT ok, '/ingress/by-order/' || ok || '/' || stem || '/' || stem
        || '_f' || lpad(CAST(ln * 1000 + pk AS VARCHAR), 4, '0') || '.jpg' AS filepath
        FROM (SELECT *, 'p-proj' || lpad(CAST(ok % 25 + 1 AS VARCHAR), 3, '0') || '_s-spec002_d-bagel_v'
              || lpad(CAST(ok % 999 + 1 AS VARCHAR), 3, '0') AS stem FROM listing)""",
    "redact_columns": """SELECT c_custkey AS customer_number, 'REDACTED' AS access_key,
        '{"segment":"' || c_mktsegment || '","root_id":"REDACTED"}' AS settings,
        'REDACTED' AS callback_url, '[{"secret_key":"REDACTED","n":"' || c_nationkey || '"}]' AS logins,
        '{"access_key":"REDACTED","nation":"' || c_nationkey || '"}' AS options FROM customer""",
    "redact_hash": """SELECT c_custkey AS customer_number, 'hash-' || sha256(c_name) AS access_key,
        '{"access_key":"hash-' || sha256(c_name) || '","nation":"' || c_nationkey || '"}' AS options
        FROM customer""",
    "group_lookup": f"""{ROWS} SELECT asset_path, count(*) AS n_files FROM rows
        WHERE asset_path IS NOT NULL GROUP BY asset_path""",
    "lookup_join": f"""{ROWS} SELECT filepath, asset_path,
        CASE WHEN asset_path IS NOT NULL THEN count(*) OVER (PARTITION BY asset_path) END AS n_files
        FROM rows""",
    "spec_lookup": f"""{ROWS}, specs(specification, asset_type, filename_fields, asset_name_fields, required_traits) AS (VALUES
        ('spec001', 'sequence', 'project_specification_descriptor_version_coordinate_frame_extension',
         'project_specification_descriptor_version', 'channels,coordinate,extension,frame,height,width'),
        ('spec002', 'sequence', 'project_specification_descriptor_version_frame_extension',
         'project_specification_descriptor_version', 'channels,extension,frame,height,width'),
        ('vdb001', 'file', 'project_specification_descriptor_version_extension',
         'project_specification_descriptor_version', 'extension'))
        SELECT r.specification, r.filepath, s.asset_type, s.filename_fields, s.asset_name_fields,
               s.required_traits FROM rows r LEFT JOIN specs s USING (specification)""",
    "missing_files": f"""{LISTING} SELECT wanted AS filepath FROM (
            SELECT regexp_replace(filepath, '[.]png$', '.jpg') AS wanted FROM listing)
        WHERE wanted NOT IN (SELECT filepath FROM listing)""",
    "missing_coordinates": f"""{POINTS}, boxes AS (
            SELECT ok, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY ok),
        wanted AS (SELECT ok, x, unnest(range(y0, y1 + 1)) AS y FROM (
            SELECT ok, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM boxes))
        SELECT ok, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (
            SELECT ok, x, y FROM wanted EXCEPT SELECT ok, x, y FROM points)""",
    "missing_values": f"""{POINTS}, wanted AS (
            SELECT ok, unnest(range(lo, hi + 1)) AS ln FROM (
                SELECT ok, min(ln) AS lo, max(ln) AS hi FROM points GROUP BY ok))
        SELECT ok, CAST(ln AS INTEGER) AS ln FROM (
            SELECT ok, ln FROM wanted EXCEPT SELECT ok, ln FROM points)""",
    "to_prototype": f"""{LISTING}, placed AS (
            SELECT *, (row_number() OVER (PARTITION BY ok ORDER BY filepath) - 1) // 4 AS part FROM listing)
        SELECT ok, part,
        string_agg(filename, ',' ORDER BY filepath) AS filenames,
        coalesce(string_agg(CAST(width AS VARCHAR), ',' ORDER BY filepath), '') AS widths,
        coalesce(string_agg(CAST(ln AS VARCHAR), ',' ORDER BY filepath) FILTER (WHERE ln % 2 = 1), '') AS odd_lines
        FROM placed GROUP BY ok, part""",
    "map_prototype": f"""{LISTING}, long AS (
            SELECT ok, filepath, 'width' AS trait, width AS value FROM listing WHERE width IS NOT NULL
            UNION ALL SELECT ok, filepath, 'line', ln FROM listing
            UNION ALL SELECT ok, filepath, 'part', pk FROM listing WHERE pk % 2 = 0)
        SELECT ok, trait, part, string_agg(CAST(value AS VARCHAR), ',' ORDER BY filepath) AS "values"
        FROM (SELECT *, (row_number() OVER (PARTITION BY ok, trait ORDER BY filepath) - 1) // 4 AS part
              FROM long) GROUP BY ok, trait, part""",
    "asset_traits": f"""{PUBLISH} SELECT asset_path, part, asset_traits
        FROM trait_lists""",
    "read_assets": f"""{CATALOG} SELECT arg_min(filename, filepath) AS filename, min(filepath) AS filepath,
        arg_min(file_error, filepath) FILTER (WHERE file_error IS NOT NULL) AS file_error,
        arg_min(asset_name, filepath) FILTER (WHERE asset_name IS NOT NULL) AS asset_name,
        asset_path, arg_min(asset_type, filepath) AS asset_type,
        arg_min(asset_error, filepath) FILTER (WHERE asset_error IS NOT NULL) AS asset_error,
        arg_min(asset_valid, filepath) AS asset_valid,
        arg_min(asset_path_relative, filepath) AS asset_path_relative,
        arg_min(filepath_relative, filepath) AS filepath_relative
        FROM catalog WHERE asset_path IS NOT NULL GROUP BY asset_path""",
    "distinct_assets": f"{ROWS} SELECT DISTINCT asset_path FROM rows",
    "coordinate_bounds": f"""{POINTS} SELECT ok, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y,
        max(y) AS max_y, CAST(NULL AS INTEGER) AS min_z, CAST(NULL AS INTEGER) AS max_z
        FROM points GROUP BY ok""",
    "asset_summary": f"""{CATALOG}, per_asset AS (
            SELECT asset_path, specification, count(*) AS n, count(*) FILTER (WHERE asset_valid) AS v
            FROM catalog WHERE asset_path IS NOT NULL GROUP BY asset_path, specification)
        SELECT specification, count(*) AS n_assets, count(*) FILTER (WHERE n = v) AS n_valid_assets,
               CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(v) AS BIGINT) AS n_valid_files
        FROM per_asset GROUP BY specification""",
    "error_text": """SELECT p_partkey, CASE WHEN len(found) = 1 THEN 'ValidationError( ' || found[1] || ' )'
        WHEN len(found) > 1 THEN 'ValidationError(' || chr(10) || array_to_string(found, chr(10)) || chr(10) || ')'
        END AS error FROM (SELECT p_partkey, list_filter([
            CASE WHEN p_partkey % 3 <> 0 THEN 'bad size ' || p_size END,
            CASE WHEN p_partkey % 2 = 0 THEN 'bad brand ' || p_brand END], lambda x: x IS NOT NULL) AS found
            FROM part)""",
    "str_to_bool": """SELECT p_partkey, p_partkey % 6 < 3 AS flag, lower(p_name) = 'true' AS name_flag
        FROM part""",
    "time_string": "SELECT event_id, strftime(ts, '%Y-%m-%dT-%H-%M-%S') AS time_text FROM events",
    "coordinate_axes": f"""{ROWS} SELECT filepath, cx AS coordinate_x, cy AS coordinate_y,
        CAST(NULL AS INTEGER) AS coordinate_z FROM rows""",
    "rule_project": _each(
        _choice(_PROJECTS, "pk % 7") + " || CASE WHEN pk % 11 = 0 THEN '' ELSE CAST(pk AS VARCHAR) END",
        "regexp_full_match(v, '[a-z]{3,10}[0-9]{1,4}')",
        _named("v", "project name"),
    ),
    "rule_descriptor": _each(
        _choice(_WORDS, "pk % 9"),
        "regexp_full_match(v, '[a-z0-9][a-z0-9-]*') AND NOT regexp_matches(v, '^(master|final|last)')",
        _named("v", "descriptor"),
    ),
    "rule_version": _each(
        "pk * 2 - 100", "v > 0 AND v < 1000",
        "v || ' is not a valid version. 0 < version < 1000.'",
    ),
    "rule_frame": _each(
        "pk * 11 - 100", "v >= 0 AND v < 10000",
        "v || ' is not a valid frame. -1 < frame < 10000.'",
    ),
    "rule_coordinate": _each(
        """CASE pk % 5 WHEN 0 THEN [pk * 11] WHEN 1 THEN [ln - 3, 0]
           WHEN 2 THEN [1, 2, pk] WHEN 3 THEN [1, 2, 3, 4] ELSE CAST([] AS INTEGER[]) END""",
        "len(v) BETWEEN 1 AND 3 AND list_min(v) >= 0 AND list_max(v) < 10000",
        "CAST(v AS VARCHAR) || ' is not a valid coordinate. -1 < coordinate < 10000.'",
    ),
    "rule_extension": _each(
        _choice(_EXTENSIONS, "pk % 6"), "regexp_full_match(v, '[a-z0-9]+')", _named("v", "extension")
    ),
    "rule_eq": _each("width", "v = 4", "v || ' != 4.'"),
    "rule_lt": _each("ln", "v < 5", "v || ' !< 5.'"),
    "rule_gt": _each("ln", "v > 2", "v || ' !> 2.'"),
    "rule_lte": _each("ln", "v <= 5", "v || ' !<= 5.'"),
    "rule_gte": _each("ln", "v >= 2", "v || ' !>= 2.'"),
    "rule_in": _each("ln", "v IN (1, 3)", "v || ' is not in [1, 3].'"),
    "rule_type": _each(
        "CASE WHEN pk % 7 = 0 THEN 'x' || pk ELSE CAST(pk AS VARCHAR) END",
        "TRY_CAST(v AS INTEGER) IS NOT NULL", "'Value ''' || v || ''' is not int.'",
    ),
    "rule_homogenous": f"""{LISTING} SELECT ok, CAST(count(*) AS BIGINT) AS n_values,
        count(DISTINCT width) + max(CASE WHEN width IS NULL THEN 1 ELSE 0 END) AS n_distinct,
        min(width) AS low, max(width) AS high,
        count(*) < 2 OR (count(DISTINCT width) = 1 AND count(width) = count(*)) AS valid
        FROM listing GROUP BY ok""",
    "rule_not_missing": f"""{POINTS} SELECT ok, count(*) AS n_values, count(DISTINCT ln) AS n_distinct,
        min(ln) AS low, max(ln) AS high,
        list_sort(list(ln)) = range(min(ln), max(ln) + 1)::INTEGER[] AS valid FROM points GROUP BY ok""",
    "rule_uniform_coordinates": f"""{POINTS}, counted AS (
            SELECT ok, x, y, count(*) AS n FROM points GROUP BY ok, x, y)
        SELECT ok, count(*) AS n_distinct, min(n) AS lowest_count, max(n) AS highest_count,
               min(n) = max(n) AS valid FROM counted GROUP BY ok""",
    "rule_dense_coordinates": f"""{POINTS} SELECT ok, count(DISTINCT (x, y)) AS n_distinct,
        CAST((max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS BIGINT) AS volume,
        count(DISTINCT (x, y)) = (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS valid
        FROM points GROUP BY ok""",
    "rule_begin_at": f"""{POINTS}, lows AS (
            SELECT ok, min(x) AS x FROM points GROUP BY ok)
        SELECT p.ok, min(p.x) || ',' || min(p.y) AS low, min(p.x) = 0 AND min(p.y) = 0 AS valid
        FROM points p JOIN lows l ON p.ok = l.ok AND p.x = l.x GROUP BY p.ok""",
    "rule_required": f"""{CATALOG} SELECT asset_path, specification, n_files FROM assets
        WHERE contains(asset_error, 'This field is required.')""",
    "rule_rogue": f"""{CATALOG} SELECT asset_path, specification, n_file_errors FROM assets
        WHERE contains(asset_error, 'Rogue field.')""",
    "validate_assets": f"{CATALOG} SELECT asset_path, specification, n_files, n_file_errors, asset_error FROM assets",
    "update": f"""{CATALOG} SELECT {_CATALOG_COLUMNS}, asset_error, asset_valid,
        asset_path_relative, filepath_relative FROM catalog""",
}

_NODES = f"""{CATALOG}, found AS (
        SELECT asset_path, arg_max(asset_valid, filepath) AS v FROM catalog
        WHERE asset_path IS NOT NULL GROUP BY asset_path),
    above AS (SELECT DISTINCT regexp_extract(asset_path, '^(.*)/[^/]+$', 1) AS d FROM found),
    every AS ({_ancestors("above", "d")} UNION SELECT asset_path FROM found)"""
ORACLE["graph_nodes"] = f"""{_NODES}
    SELECT 'root' || e.directory AS node_id, regexp_extract(e.directory, '([^/]+)$', 1) AS label,
           CASE WHEN f.v THEN '#A0D17B' WHEN NOT f.v THEN '#DE958E' ELSE '#B6ECF3' END AS color
    FROM every e LEFT JOIN found f ON e.directory = f.asset_path"""
ORACLE["graph_edges"] = f"""{_NODES}
    SELECT 'root' || regexp_extract(directory, '^(.*)/[^/]+$', 1) AS source,
           'root' || directory AS target FROM every
    WHERE regexp_extract(directory, '^(.*)/[^/]+$', 1) <> ''"""



_SETS = f"""
coordinates AS (
    SELECT asset_path, cx, cy, count(*) AS n FROM rows
    WHERE specification = 'spec001' AND cx IS NOT NULL GROUP BY asset_path, cx, cy),
box AS (
    SELECT asset_path, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, max(n) AS top,
           min(n) AS bottom, min([cx, cy]) AS low
    FROM coordinates GROUP BY asset_path),
rare AS (
    SELECT asset_path, list([cx, cy] ORDER BY cx, cy) AS points
    FROM coordinates JOIN box USING (asset_path) WHERE n < top GROUP BY asset_path),
whole AS (
    SELECT asset_path, x, unnest(range(y0, y1 + 1)) AS y
    FROM (SELECT asset_path, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM box)),
holes AS (
    SELECT asset_path, list([x, y] ORDER BY x, y) AS points FROM (
        SELECT asset_path, x, y FROM whole EXCEPT SELECT asset_path, cx, cy FROM coordinates)
    GROUP BY asset_path),
frames AS (
    SELECT asset_path, count(*) AS n, count(DISTINCT frame) AS d, min(frame) AS low, max(frame) AS high,
           list_sort(list_distinct(list(frame))) AS seen
    FROM rows WHERE specification = 'spec002' AND frame IS NOT NULL GROUP BY asset_path),
gaps AS (
    SELECT asset_path, seen[i] + 1 AS first, seen[i + 1] - 1 AS last
    FROM (SELECT asset_path, seen, unnest(range(1, len(seen))) AS i FROM frames WHERE n <> high - low + 1 OR d <> n)
    WHERE seen[i + 1] > seen[i] + 1),
named_frames AS (
    SELECT asset_path, CASE WHEN sum(last - first + 1) <= 100
        THEN CAST(flatten(list(range(first, last + 1) ORDER BY first)) AS VARCHAR)
        ELSE '[' || string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '..' || last END, ', '
                               ORDER BY first) || ']' END AS names
    FROM gaps GROUP BY asset_path),
same AS (
    SELECT asset_path,
           CASE WHEN count(DISTINCT descriptor) > 1 THEN 'descriptor: values from ' || min(descriptor) || ' to '
                || max(descriptor) || ' are not homogenous.' END AS descriptors,
           CASE WHEN specification = 'spec002' AND count(DISTINCT trait_width) > 1
                THEN 'width: values from ' || min(trait_width) || ' to ' || max(trait_width)
                || ' are not homogenous.' END AS widths
    FROM rows WHERE specification IN ('spec001', 'spec002') GROUP BY asset_path, specification),
set_assets AS (
    SELECT a.asset_path, specification, n_files, n_file_errors, list_sort(list_concat(texts, list_filter([
        descriptors, widths,
        CASE WHEN top <> bottom THEN 'coordinate: Non-uniform coordinate count. Missing coordinates: '
             || CAST(r.points AS VARCHAR) || '.' END,
        CASE WHEN h.points IS NOT NULL THEN 'coordinate: Non-dense coordinates. Missing coordinates: '
             || CAST(h.points AS VARCHAR) || '.' END,
        CASE WHEN box.low <> [0, 0] THEN 'coordinate: Coordinates do not begin at [0, 0].' END,
        CASE WHEN f.n <> f.high - f.low + 1 OR f.d <> f.n
             THEN 'frame: Missing values: ' || coalesce(names, '[]') || '.' END
        ], lambda x: x IS NOT NULL))) AS texts
    FROM problems a LEFT JOIN same USING (asset_path) LEFT JOIN box USING (asset_path)
    LEFT JOIN rare r USING (asset_path) LEFT JOIN holes h USING (asset_path)
    LEFT JOIN frames f USING (asset_path) LEFT JOIN named_frames USING (asset_path))"""
ORACLE["validate_sets"] = f"""{CATALOG}, {_SETS} SELECT asset_path, specification, n_files, n_file_errors,
    CASE WHEN len(texts) > 0 THEN 'DataError( ' || array_to_string(texts, ' ') || ' )' END AS asset_error
    FROM set_assets"""
ORACLE["group_merge"] = f"""{ROWS} SELECT asset_path, CASE WHEN count(frame) = 0 THEN 'none' ELSE
    min(frame) || '-' || max(frame) || ' ' || count(frame) || ' ' || CAST(sum(frame) AS BIGINT) // count(frame) END AS frames
    FROM rows WHERE asset_path IS NOT NULL GROUP BY asset_path"""
ORACLE["validate_own"] = f"""{CATALOG}, own AS (
        SELECT asset_path, list_filter([
            CASE WHEN specification = 'spec001' AND max(version) % 7 = 0
                 THEN 'version: ' || max(version) || ' is a multiple of seven.' END,
            CASE WHEN specification = 'spec001' AND max(cx + cy) >= 3
                 THEN 'coordinate: [' || arg_min(cx || ', ' || cy, filepath) FILTER (WHERE cx + cy >= 3) || '] is too far out.' END,
            CASE WHEN specification = 'spec001' AND count(DISTINCT (cx, cy)) FILTER (WHERE cx IS NOT NULL) > 1
                 THEN 'coordinate: ' || count(DISTINCT (cx, cy)) FILTER (WHERE cx IS NOT NULL) || ' places.' END,
            CASE WHEN specification = 'spec002' AND max(frame) >= 4000
                 THEN 'frame: ' || arg_min(frame, filepath) FILTER (WHERE frame >= 4000) || ' is late.' END
            ], lambda x: x IS NOT NULL) AS more
        FROM rows WHERE asset_path IS NOT NULL GROUP BY asset_path, specification),
    told AS (SELECT p.*, list_sort(list_concat(texts, more)) AS every FROM problems p JOIN own USING (asset_path))
    SELECT asset_path, specification, n_files, n_file_errors,
        CASE WHEN len(every) > 0 THEN 'DataError( ' || array_to_string(every, ' ') || ' )' END AS asset_error
    FROM told"""
ORACLE["typed_traits"] = f"""{CATALOG}, own AS (
        SELECT asset_path, list_filter([
            CASE WHEN max(ok) % 3 + max(ok) % 7 >= 7
                 THEN 'parts: [' || max(ok) % 3 || ', ' || max(ok) % 7 || '] is too much.' END,
            CASE WHEN max(ok) % 2 = 1 THEN 'even: false != True.' END,
            CASE WHEN max(ok) % 5 = 0 THEN 'rest: Value ''none'' is not int.'
                 WHEN max(ok) % 10 <= 2 THEN 'rest: ' || max(ok) % 10 || ' !> 2.' END
            ], lambda x: x IS NOT NULL) AS more
        FROM rows WHERE specification = 'vdb001' GROUP BY asset_path),
    told AS (SELECT p.*, list_sort(list_concat(texts, more)) AS every FROM problems p JOIN own USING (asset_path))
    SELECT asset_path, specification, n_files, n_file_errors,
        CASE WHEN len(every) > 0 THEN 'DataError( ' || array_to_string(every, ' ') || ' )' END AS asset_error
    FROM told"""
_TOLD = """told AS (SELECT *, CASE WHEN len(texts) > 0 THEN 'DataError( ' || array_to_string(list_sort(texts), ' ') || ' )' END
             AS asset_error FROM judged)
    SELECT asset_path, specification, n_files, n_file_errors, asset_error FROM told"""


def _absent(trait: str, column: str) -> str:
    return f"CASE WHEN count({column}) = 0 THEN '{trait}: This field is required.' END"


ORACLE["validate_examples"] = f"""{ROWS}, judged AS (
        SELECT asset_path, specification, count(*) AS n_files, count(file_error) AS n_file_errors, list_filter([
            CASE WHEN count(filename_error) > 0 THEN 'filename_error: Rogue field.' END,
            {_absent("extension", "name_extension")},
            CASE WHEN specification <> 'vdb001' THEN {_absent("frame", "frame")} END,
            CASE WHEN specification = 'spec001' THEN {_absent("descriptor", "descriptor")} END,
            CASE WHEN specification = 'spec001' AND count(DISTINCT descriptor) > 1 THEN 'descriptor: values from '
                 || min(descriptor) || ' to ' || max(descriptor) || ' are not homogenous.' END,
            CASE WHEN specification = 'spec002' THEN 'width: ' || arg_min(trait_width, filepath) || ' != 1024.' END,
            CASE WHEN specification = 'spec002' THEN 'height: ' || arg_min(trait_height, filepath) || ' != 1024.' END
            ], lambda x: x IS NOT NULL) AS texts
        FROM rows WHERE asset_path IS NOT NULL GROUP BY asset_path, specification), {_TOLD}"""
_RAW = _with(
    _LISTING.replace("'raw009'", "'raw001'"),
    _FILES.replace("'spec002'", "'raw001'").replace("('spec001', 'raw001', 'vdb001')", "('raw001')"),
)
ORACLE["validate_shipped"] = f"""{_RAW}, judged AS (
        SELECT asset_path, specification, count(*) AS n_files, count(file_error) AS n_file_errors, list_filter([
            CASE WHEN count(filename_error) > 0 THEN 'filename_error: Rogue field.' END,
            {_absent("extension", "name_extension")}, {_absent("frame", "frame")}
            ], lambda x: x IS NOT NULL) AS texts
        FROM rows WHERE known GROUP BY asset_path, specification), {_TOLD}"""
ORACLE["set_summary"] = f"""{CATALOG}, {_SETS} SELECT specification, count(*) AS n_assets,
    count(*) FILTER (WHERE len(texts) = 0 AND n_file_errors = 0) AS n_valid_assets,
    CAST(sum(n_files) AS BIGINT) AS n_files,
    CAST(sum(CASE WHEN len(texts) = 0 THEN n_files - n_file_errors ELSE 0 END) AS BIGINT) AS n_valid_files
    FROM set_assets GROUP BY specification"""
_GRID = """SELECT DISTINCT l_suppkey, l_partkey % 23 AS x, CAST(l_linenumber AS BIGINT) AS y, l_orderkey % 5 AS z FROM lineitem"""


def _gaps(line: str, axis: str, ends: str) -> str:
    """Stretches of an axis that no point of a line has, within the group's box."""
    columns = line.replace(" ", "").split(",")
    return f"""SELECT {ends} FROM (
        SELECT *, lead(v) OVER (PARTITION BY {line} ORDER BY v) AS w FROM (
            SELECT DISTINCT {line}, {axis} AS v FROM grid
            UNION SELECT DISTINCT p.{", p.".join(columns)}, b.{axis}0 - 1 FROM grid p JOIN box b USING (l_suppkey)
            UNION SELECT DISTINCT p.{", p.".join(columns)}, b.{axis}1 + 1 FROM grid p JOIN box b USING (l_suppkey)))
        JOIN box USING (l_suppkey) WHERE w > v + 1"""


ORACLE["missing_boxes"] = f"""WITH grid AS ({_GRID}), box AS (
        SELECT l_suppkey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1
        FROM grid GROUP BY l_suppkey)
    {_gaps("l_suppkey", "x", "l_suppkey, v + 1 AS x0, w - 1 AS x1, y0, y1, z0, z1")}
    UNION ALL {_gaps("l_suppkey, x", "y", "l_suppkey, x, x, v + 1, w - 1, z0, z1")}
    UNION ALL {_gaps("l_suppkey, x, y", "z", "l_suppkey, x, x, y, y, v + 1, w - 1")}"""


def _state(kept: str, width: str) -> str:
    """The catalog of a listing that is not the whole one."""
    return CATALOG.replace(
        "listing AS (", "every AS (", 1
    ).replace(
        "FROM names)", f"FROM names), listing AS (SELECT * REPLACE (CAST({width} AS INTEGER) AS width) FROM every WHERE {kept})", 1
    )


_BEFORE = _state("pk % 13 <> 1", "CASE WHEN pk % 17 = 2 AND width IS NOT NULL THEN 40 ELSE width END")
_AFTER = _state("pk % 11 <> 5", "width")
ORACLE["catalog_update"] = f"""{_AFTER} SELECT {_CATALOG_COLUMNS}, asset_error, asset_valid,
    asset_path_relative, filepath_relative FROM catalog"""
ORACLE["catalog_changes"] = f"""SELECT coalesce(a.filepath, b.filepath) AS filepath,
        CASE WHEN a.filepath IS NULL THEN 'added' WHEN b.filepath IS NULL THEN 'removed' ELSE 'changed' END AS change,
        a.asset_path AS asset_path_before, b.asset_path AS asset_path_after,
        a.asset_error AS asset_error_before, b.asset_error AS asset_error_after,
        a.asset_valid AS asset_valid_before, b.asset_valid AS asset_valid_after
    FROM ({_BEFORE} SELECT * FROM catalog) a FULL JOIN ({_AFTER} SELECT * FROM catalog) b ON a.filepath = b.filepath
    WHERE a.filepath IS NULL OR b.filepath IS NULL OR a.asset_error IS DISTINCT FROM b.asset_error
       OR a.asset_valid <> b.asset_valid OR a.file_traits IS DISTINCT FROM b.file_traits"""

ORACLE["stream_update"] = ORACLE["update"]
ORACLE["stream_asset_state"] = ORACLE["asset_summary"]
_FILES_OF_PART = """SELECT 'm' || p_partkey % 7 || '/part' || p_partkey || '.txt' AS name,
    p_name || chr(10) || p_brand AS value FROM part"""
ORACLE["stage_content"] = f"""SELECT name AS target, CAST(strlen(value) AS BIGINT) AS bytes, sha256(value) AS sha256,
    'copied' AS status FROM ({_FILES_OF_PART})"""
ORACLE["export_objects"] = f"""SELECT name AS object_key, CAST(strlen(value) AS BIGINT) AS bytes,
    sha256(value) AS sha256 FROM ({_FILES_OF_PART})"""
ORACLE["read_metadata"] = "SELECT p_partkey, p_name, p_brand, p_size FROM part"
ORACLE["export_disk"] = """SELECT 'm' || p_partkey % 7 || '/p-proj' || lpad(CAST(p_partkey % 25 + 1 AS VARCHAR), 3, '0')
    || '_s-vdb001_d-part' || p_partkey || '_v' || lpad(CAST(p_partkey % 999 + 1 AS VARCHAR), 3, '0') || '.vdb' AS name,
    sha256(p_name) AS sha256 FROM part WHERE p_partkey % 9 <> 4 AND p_partkey % 10 <> 3"""

for _name, _sql in SEARCHES.items():
    ORACLE[_name] = f"{DATA} {_sql}"
ORACLE["search_running_count"] = ORACLE["search_running_count"].replace(
    "sum(n_files) OVER", "CAST(sum(n_files) OVER"
).replace("CURRENT ROW)", "CURRENT ROW) AS BIGINT)")
ORACLE["search_group_by"] = ORACLE["search_group_by"].replace(
    "sum(CASE WHEN asset_valid THEN 1 ELSE 0 END)",
    "CAST(sum(CASE WHEN asset_valid THEN 1 ELSE 0 END) AS BIGINT)",
)
ORACLE["search_scalar"] = ORACLE["search_scalar"].replace(
    "length(filename) AS name_length", "CAST(length(filename) AS INTEGER) AS name_length"
)
ORACLE["search_cte"] = f"{DATA} {CTE_SEARCH.format(lead=',')}"
ORACLE["search_group_concat"] = DATA + GROUP_CONCAT_SEARCH.format(
    list="string_agg(CAST(version AS VARCHAR), ',' ORDER BY CAST(version AS VARCHAR))"
)
ORACLE["search_recursive"] = DATA.replace("WITH ", "WITH RECURSIVE ", 1) + RECURSIVE_SEARCH.format(lead=",")
