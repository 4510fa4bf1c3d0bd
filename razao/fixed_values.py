"""The words, patterns, messages and formats that results depend on.

They are stated as plain text, in one place, and carry no logic.
"""

# Terms removed from a counterparty key, as whole words.
COUNTERPARTY_STOP_TERMS = (
    "pix recebido",
    "pix enviado",
    "pix",
    "transferencia",
    "transf",
    "pagamento",
    "recebimento",
    "ted",
    "doc",
)

# Terms that mark a transfer between accounts of the same owner (substring match).
OWN_TRANSFER_STRONG_TERMS = (
    "transferencia entre contas",
    "transf entre contas",
    "entre contas",
    "conta propria",
    "mesma titularidade",
)

# Name between the kind of a transfer and a masked or plain tax number.
COUNTERPARTY_CAPTURE_PATTERN = (
    r"(?:transfer[eê]ncia\s+(?:recebida?|enviada?|estorno)?\s*(?:pelo\s+pix)?"
    r"|reembolso\s+recebido\s*(?:pelo\s+pix)?|pix\s+(?:recebido|enviado)"
    r"|recebida?(?:\s+pelo\s+pix)?|enviada?(?:\s+pelo\s+pix)?)"
    r"\s*-\s*(.+?)\s*-\s*[•\d]"
)

# Kind of a transfer at the start of a description.
COUNTERPARTY_PREFIX_PATTERN = (
    r"^(?:pix\s+(?:enviado|recebido)\s*[-–]?\s*|pix\s*[-–]\s*"
    r"|pagamento\s+efetuado\s*[-–]?\s*"
    r"|reembolso\s+recebido\s*(?:pelo\s+pix)?\s*[-–]?\s*"
    r"|transfer[eê]ncia\s+(?:enviada?|recebida?)?\s*(?:pelo\s+pix)?\s*[-–]?\s*"
    r"|compra\s+no\s+(?:d[eé]bito|cr[eé]dito)\s*)"
)

# Emoji blocks dropped from a description's cluster key.
EMOJI_PATTERN = r"[[^\x00-\x7F]&&[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}]]"

# White space as browsers' regular expressions and trim() see it.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The first part lets Java's matcher leave visible ASCII characters, most of all text, without trying every range.
WHITESPACE_CLASS = r"[[^!-~]&&[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"

# Statement dialects.
INTER_DETECT_MARKS = ("data lançamento", "data lancamento")
INTER_HEADER_MARK = "data lan"
INTER_COLUMNS = {
    "date": "data lancamento",
    "history": "historico",
    "description": "descricao",
    "amount": "valor",
}
INTER_BANK_NAME = "Inter"
NUBANK_DETECT_MARK = "identificador"
NUBANK_COLUMNS = ("data", "valor", "identificador", "descricao")
NUBANK_BANK_NAME = "Nubank"
SOURCE_LABELS = {"inter": "Inter", "nubank": "Nubank", "generic": "Genérico"}
STATEMENT_DATE_FORMAT = "dd/MM/yyyy"

# Messages of file-level errors.
UNKNOWN_FORMAT_MESSAGE = "formato não reconhecido (esperado Inter ou Nubank CSV)"
NO_TRANSACTIONS_MESSAGE = "nenhuma transação encontrada no arquivo"
ALREADY_IMPORTED_MESSAGE = "já foi importado"

# Money.
CURRENCY = "BRL"
PRECISION = 2
CURRENCY_SYMBOLS = {"BRL": "R$", "USD": "US$", "EUR": "€", "GBP": "£", "JPY": "JP¥"}

# 32-bit FNV-1a.
FNV_OFFSET_BASIS = 2166136261
FNV_PRIME = 16777619

DAY_MILLIS = 86400000
PAGE_SIZE = 200
