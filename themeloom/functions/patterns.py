"""Patterns of the cleaning steps.

Fixed values: results depend on them being exactly these. The same text is valid for the
Java engine Spark uses and for RE2, except where a comment says otherwise.
"""

# Characters that count as white space (the Unicode set, so a no-break space is one too).
# Single characters and one class: the Java engine tests ranges one after the other.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"

WORD = f"[^{SPACE}]+"
LEADING_SPACE = f"^[{SPACE}]+"
TRAILING_SPACE = rf"[{SPACE}]+\z"

# HTML, read from left to right as a parser does: a comment, an element whose content is no
# text, or a tag. A quoted value may hold a ">"; a tag whose quotes do not close ends at the
# next ">".
_COMMENT = r"!--.*?-->"
_RAW_ELEMENT = r"(?i:(?:script|style|template)\b[^>]*>.*?</(?:script|style|template)\s*>)"
_TAG_WITH_VALUES = rf"/?[a-zA-Z!?][^>=]*(?:(?:=[{SPACE}]*\"[^\"]*\"|=[{SPACE}]*'[^']*'|=)[^>=]*)*>"
_TAG = r"/?[a-zA-Z!?][^>]*>"
HTML_MARKUP = f"(?s)<(?:{_COMMENT}|{_RAW_ELEMENT}|{_TAG_WITH_VALUES}|{_TAG})"
# Java only: the same without going back over a choice once made.
_TAG_WITH_VALUES_JAVA = rf"/?[a-zA-Z!?][^>=]*+(?>(?:=[{SPACE}]*+\"[^\"]*+\"|=[{SPACE}]*+'[^']*+'|=)[^>=]*+)*+>"
HTML_MARKUP_JAVA = f"(?s)<(?:{_COMMENT}|{_RAW_ELEMENT}|{_TAG_WITH_VALUES_JAVA}|{_TAG})"
HTML_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

# Markdown
CODE_FENCE = r"(?s)```.*?```"
MARKS = r"[#*_>\-`~]"
URL = f"http[^{SPACE}]+|www[^{SPACE}]+"
IMAGE_LINK = r"!\[.*?\]\(.*?\)"

NOT_LETTER_OR_SPACE = rf"[^\p{{L}}{SPACE}]"

# LaTeX
LATEX_COMMENT = r"(?m)(^|[^\\])%.*$"
LATEX_PREAMBLE = r"(?s)^.*?\\begin\{document\}"
LATEX_AFTER_END = r"(?s)\\end\{document\}.*"
LATEX_FLOAT = (
    r"(?s)\\begin\{(figure|table|equation|align|displaymath|math|lstlisting|verbatim|tikzpicture)\*?\}"
    r".*?\\end\{(figure|table|equation|align|displaymath|math|lstlisting|verbatim|tikzpicture)\*?\}"
)
LATEX_DISPLAY_MATH = r"(?s)\$\$.*?\$\$|\\\[.*?\\\]"
LATEX_INLINE_MATH = r"\$[^$\n]*\$"
LATEX_REFERENCE = r"\\(cite|citep|citet|ref|eqref|pageref|label|bibliography|bibliographystyle|includegraphics|input|include)\*?(\[[^\]]*\])?\{[^{}]*\}"
LATEX_ENVIRONMENT = r"\\(begin|end)\{[^{}]*\}(\[[^\]]*\])?"
LATEX_UNWRAP = r"\\[a-zA-Z]+\*?(\[[^\]]*\])?\{([^{}]*)\}"
LATEX_COMMAND = r"\\[a-zA-Z]+\*?|\\."
LATEX_LEFTOVER = r"[{}~&$]"
LATEX_NESTING = 3  # rounds of unwrapping, innermost braces first

# Tokens: runs of letters and digits; a run with a digit in it is no word.
TOKEN_RUN = r"[\p{L}\p{N}]+"
LETTERS = r"\p{L}+"
# Java only, one pass for both: a run of letters with no letter or digit on either side.
LETTER_RUN = r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"
