"""Patterns and names that define the trace format."""

# The trace format's patterns and register names.
LEGACY_CHANGE = r"(\w+)=([^\s,]+?)\s*->\s*([^\s,]+)"
ASSIGNMENT = r"\b([A-Za-z][\w.]*)\s*=\s*([^\s,]+)"
TRANSITION = r"\b([A-Za-z][\w.]*)\s*=\s*([^\s,]+?)\s*->\s*([^\s,]+)"
STRING_HINT = r'\b([A-Za-z][\w.]*)\s*=\s*[^\s,]+\s*\(string:\s*"([^"]*)"\)'
BEFORE_TRACE_PART = r'(?s)^.*?:\s*"[^"]*"\s*'
BRACKETS = r"^(?:\[[^\]]+\]\s*)+"
QUOTED = r'^0x[0-9a-fA-F]+:\s*"[^"]*"'
BRACKET_OFFSET = r"\[[^\]]*?(0x[0-9a-fA-F]+)\s*\]"
SHIFT_AMOUNT = r"#\s*(-?0x[0-9a-fA-F]+|-?\d+)"
MEMORY_WRITE = r"(?i)memory write at (0x[0-9a-f]+), instruction address = (0x[0-9a-f]+), data size = (\d+), data value = ([0-9a-f]+)"
MEMORY_READ = r"(?i)memory read at (0x[0-9a-f]+), instruction address = (0x[0-9a-f]+), data size = (\d+), data value = ([0-9a-f]+)"
DUMP_LINE = r"(?i)^[*\s]?[0-9a-f]+\s+[0-9a-f\s]+\|"
DUMP_BYTE = r"(?i)^[0-9a-f]{2}$"
INITIAL_SP = r"(?i)Original SP:\s*(0x[0-9a-f]+)"
OPERAND_REGISTER = r"(?i)\b([xw]\d+|sp|fp|lr|xzr|wzr)\b"
ZERO_REGISTERS = ("XZR", "WZR", "ZR")
LABELS = {
    "exact": "exact byte match", "overlap": "overlap byte match", "address": "address overlap", "scan_address": "地址重叠",
}
SCOPES = {"comment": "寄存器/注释", "operands": "操作数", "memory": "内存数据", "dump": "内存Dump", "raw": "原始行"}
