"""Explicit schemas of the fact tables. Ids and counts are BIGINT, 0/1 flags INT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Table, then its columns; b = BIGINT, i = INT, s = STRING, d = DOUBLE. Fixed values of the data model.
_TABLES = """
semantic_universe id:b key:s name:s policy:s
repository id:b name:s kind:s remote_url:s active_clone_id:b semantic_universe_id:b
component id:b name:s path:s kind:s version:s repository_id:b semantic_universe_id:b
directory id:b component_id:b path:s
file id:b directory_id:b name:s mtime:d md5:s compile_options:s driver:s indexed:i indexed_at:s args_overridden:i
symbol id:b usr:s spelling:s qual_name:s display_name:s kind:i type_info:s file_id:b line:i col:i end_line:i end_col:i decl_file_id:b decl_line:i decl_col:i decl_path:s is_definition:i is_pure:i is_static:i is_instantiation:i callable_kind:s template_origin:s template_form:s is_named_instance:i linkage:s access:s parent_usr:s parent_id:b resolved:i multi_def:i const_value:s semantic_universe_id:b identity_key:s
edge id:b src_id:b dst_id:b kind:i count:b base_access:i is_virtual:i vtable_slot:i
edge_site edge_id:b file_id:b line:i col:i conditional:i args_sig:s recv_src_kind:s recv_type_usr:s recv_decl_usr:s recv_src_kind_id:i recv_type_id:b recv_decl_id:b recv_type_identity_id:b recv_decl_identity_id:b recv_param_pos:i recv_type_is_value:i
call_arg edge_id:b file_id:b line:i col:i position:i src_kind:s type_usr:s decl_usr:s callee_usr:s src_kind_id:i type_id:b decl_id:b callee_id:b type_identity_id:b decl_identity_id:b callee_identity_id:b type_is_value:i
template_param owner_id:b position:i param_kind:i name:s default_txt:s type_id:b default_type_id:b default_ref_id:b
template_arg owner_id:b position:i pack_index:i arg_kind:i ref_id:b literal:s type_id:b
decl_site symbol_id:b file_id:b line:i col:i end_line:i end_col:i is_definition:i
definition id:b symbol_id:b component_id:b file_id:b line:i col:i end_line:i end_col:i init_text:s
def_edge id:b src_def_id:b dst_id:b kind:i count:b
possible_call src_def_id:b dst_def_id:b count:b
entity_node id:b kind:i
entity_edge src_id:b dst_id:b kind:i count:b via_member_id:b multiplicity:i access:i is_virtual:i create_form:i partial:i
type_node id:b type_key:s spelling:s kind:i is_const:i is_volatile:i is_restrict:i decl_usr:s decl_id:b canonical_id:b extent:s
type_edge src_id:b kind:i position:i dst_id:b
parameter owner_id:b position:i pack_index:i name:s type_id:b declared_type_id:b adjusted_type_id:b default_text:s default_origin:s reference_semantics:s file_id:b line:i col:i
symbol_type symbol_id:b kind:i type_id:b
include_config id:b digest:s
include_edge id:b src_file_id:b dst_file_id:b dst_path:s config_id:b is_system:i is_generated:i count:b
include_site id:b edge_id:b line:i col:i begin_offset:i end_offset:i spelling:s is_angled:i directive:s cond_fingerprint:s resolved:i guarded:i
macro_use file_id:b symbol_id:b config_id:b
fact_applicability fact_kind:s fact_id:b file_id:b config_id:b generation:b
external_identity id:b identity_kind:i identity_text:s resolution_status:i symbol_id:b type_id:b
meta key:s value:s
ast_file id:b path:s is_main:i
ast_node_kind id:b name:s category:s
ast_relation_kind id:b name:s
ast_symbol id:b usr:s name:s kind_id:b linkage:s
ast_node id:b kind_id:b symbol_id:b usr:s type_id:b spelling:s file_id:b line:i col:i end_line:i end_col:i is_definition:i
ast_edge src_id:b dst_id:b rel_id:b ord:i
"""

_TYPES = {"b": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "d": T.DoubleType()}


def _read() -> dict[str, T.StructType]:
    out = {}
    for line in _TABLES.strip().splitlines():
        name, *columns = line.split()
        out[name] = T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split(":") for c in columns)])
    return out


SCHEMAS: dict[str, T.StructType] = _read()


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of a fact table: missing ones null, others left out."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
