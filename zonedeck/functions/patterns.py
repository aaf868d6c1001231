"""Patterns that decide what a source program contains.

``(?U)`` makes words, blanks and word borders follow Unicode, on every Java version; ``(?d)`` makes
only a newline end a line.
"""

# Command blocks, storage clauses, dataset hints and level-01 records.
COMMAND_BLOCK = r"(?isU)EXEC\s+CICS\b.*?END-EXEC"
PACKED_USAGE = r"(?iU)\bCOMP-3\b|\bPACKED-DECIMAL\b"
BINARY_USAGE = r"(?iU)\bCOMP\b|\bCOMP-4\b|\bBINARY\b"
DATASET_HINT = r"(?isU)EBCDIC|VSAM|KSDS|ESDS|RRDS|FD\s+\w+.*?RECORDING\s+MODE"
RECORD = r"(?dmsU)^[ \t]*01\s+\w+.*?(?=^[ \t]*01\s+|\z)"

# Keyword rules, in the order they are tried, and the tag every program gets.
ALWAYS_TAG = "decimal_precision"
KEYWORD_RULES = [
    (r"(?iU)\bPIC\b|\bPICTURE\b", "pic_clause"),
    (r"(?iU)\bCOMP\b|\bCOMP-3\b|\bBINARY\b|\bPACKED", "pic_comp"),
    (r"(?iU)\bCOMPUTE\b", "compute"),
    (r"(?iU)\bADD\b|\bSUBTRACT\b|\bMULTIPLY\b|\bDIVIDE\b", "add_subtract_multiply_divide"),
    (r"(?iU)\bPERFORM\b", "perform"),
    (r"(?iU)\bIF\b|\bELSE\b|\bEVALUATE\b", "if_evaluate"),
    (r"(?iU)\bMOVE\b", "move"),
    (r"(?iU)\bOCCURS\b", "occurs"),
    (r"(?iU)\bREDEFINES\b", "redefines"),
    (r"(?iU)\bCOPY\b", "copy_books"),
    (r"(?iU)\bREAD\b|\bWRITE\b|\bOPEN\b|\bCLOSE\b|\bFD\b|\bSELECT\b", "read_write"),
    (r"(?iU)\bCALL\b|\bLINKAGE\b", "call_linkage"),
    (r"(?iU)\bDISPLAY\b|\bACCEPT\b", "display_accept"),
    (r"(?iU)\bSTRING\b|\bUNSTRING\b", "string_unstring"),
    (r"(?iU)\bINSPECT\b", "inspect"),
    (r"(?iU)\bFUNCTION\b", "intrinsic_functions"),
    (r"(?iU)\bWORKING-STORAGE\b", "working_storage"),
    (r"(?iU)\bPROCEDURE DIVISION\b", "procedure_div"),
    (r"(?iU)\bSTOP RUN\b|\bGOBACK\b", "stop_run_goback"),
    (r"(?iU)\bDATE\b|\bTIME\b", "date_handling"),
    (r"(?iU)\bROUNDED\b|\bON SIZE ERROR\b", "decimal_precision"),
    (r"(?iU)\bSIGN\b|\bLEADING\b|\bTRAILING\b", "sign_handling"),
    (r"(?iU)\b(interest|loan|amort|annuity)\b", "interest_calculation"),
    (r"(?iU)\b(payroll|gross.pay|net.pay|tax.rate)\b", "payroll_patterns"),
]

# Commands by category.
COMMANDS = {
    "File control": ["READ", "READNEXT", "READPREV", "WRITE", "REWRITE", "DELETE", "STARTBR", "ENDBR"],
    "Program control": ["LINK", "XCTL", "RETURN", "ABEND"],
    "Storage": ["GETMAIN", "FREEMAIN"],
    "Terminal I/O": ["SEND", "RECEIVE", "SEND MAP", "RECEIVE MAP"],
    "Temporary storage": ["READQ TS", "WRITEQ TS", "DELETEQ TS"],
    "Transient data": ["READQ TD", "WRITEQ TD"],
    "Interval control": ["DELAY", "ASKTIME", "FORMATTIME"],
    "Syncpoint": ["SYNCPOINT", "SYNCPOINT ROLLBACK"],
}

# The lines around a translated block.
STUB_OPEN, STUB_CLOSE = "# [SLM-CICS-TRANSLATED]", "# [/SLM-CICS-TRANSLATED]"
