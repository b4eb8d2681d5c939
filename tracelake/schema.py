"""Schemas of the tables of a trace, as DDL."""

CHANGE = "struct<ordinal:int,register:string,old_value:string,new_value:string>"
OPERATION = "struct<slot:int,type:string,address:string,instruction_address:string,data_size:int,data_value:string>"
DUMP = "struct<slot:int,address:string,data:array<string>,is_modified:boolean>"

TABLES = {
    "listing": f"idx long, file_offset long, address string, offset string, offset_val long, mnemonic string, operands string, comment string, raw_line string, stated array<{OPERATION}>, memory_dump array<{DUMP}>, raw_lines array<string>",
    "instruction": f"idx long, file_offset long, address string, offset string, offset_val long, mnemonic string, operands string, comment string, raw_line string, register_changes array<{CHANGE}>, memory_ops array<{OPERATION}>, memory_dump array<{DUMP}>, raw_lines array<string>",
    "register_write": "idx long, ordinal int, register string, state_reg string, analysis_reg string, is_w boolean, value long",
    "memory_access": "idx long, slot int, kind string, addr long, addr_hex string, bucket string, size int, address string, data_value string, value_bytes string, source_registers array<string>",
    "file_part": "path string, part long, first_idx long, last_idx long",
    "register": "analysis_reg string, n long, first_idx long, last_idx long",
    "bucket": "bucket string, n long, n_writes long, lowest long, highest long, widest int, first_idx long, last_idx long",
    "memory_def_use": "idx long, slot int, at long, last_writes array<struct<write_idx:long,write_slot:int>>",
    "by_address": "address string, idx long",
    "by_offset": "offset_val long, idx long",
    "offset_rank": "offset_val long, chunk long, n long",
    "by_mnemonic": "mnemonic string, idx long",
    "mnemonic_rank": "mnemonic string, chunk long, n long",
    "by_gram": "gram string, block long, within array<int>",
    "gram": "gram string, n long",
    "checkpoint": "idx long, register string, value long",
    "mnemonic": "mnemonic string, n long, first_idx long",
    "def_use": "idx long, reg string, def_idx long",
}
