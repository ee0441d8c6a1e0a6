"""Fixed values of the receipt domain: word lists, aliases, classes and patterns."""

from __future__ import annotations

# Unit aliases and the units they stand for.
UNIT_ALIASES = {
    "un": "un", "und": "un", "unid": "un", "unidade": "un", "unidades": "un", "pc": "un", "pç": "un", "pçs": "un", "pcs": "un",
    "kg": "kg", "quilo": "kg", "quilograma": "kg", "quilogramas": "kg",
    "g": "g", "grama": "g", "gramas": "g",
    "l": "l", "lt": "l", "litro": "l", "litros": "l",
    "ml": "ml", "mililitro": "ml", "mililitros": "ml",
    "m": "m", "metro": "m", "metros": "m",
    "cx": "cx", "caixa": "cx", "caixas": "cx",
    "pct": "pct", "pacote": "pct", "pacotes": "pct",
    "fd": "fd", "fardo": "fd", "fardos": "fd",
    "sc": "sc", "saco": "sc", "sacos": "sc",
    "dz": "dz", "duzia": "dz", "duzias": "dz",
}

# Rewrites of receipt text, applied in this order.
RECEIPT_REWRITES = [
    (r"&", " e "),
    (r"\bp\s*/\s*", " para "),
    (r"\bc\s*/\s*(\d+)", " c $1 "),
    (r"\bref(?:ri|rig)?\b", " refrigerante "),
    (r"\bcerv\b", " cerveja "),
    (r"\bp\s*hig\b", " papel higienico "),
    (r"\bqjo\b", " queijo "),
    (r"\bacuc\b", " acucar "),
    (r"\bbisc\b", " biscoito "),
    (r"\bmist\b", " mistura "),
    (r"\bconc\b", " concentrado "),
    (r"\bqtde\.?\b", " quantidade "),
    (r"\bqtd\.?\b", " quantidade "),
    (r"\bvl\.?\b", " valor "),
    (r"\bcod\.?\b", " codigo "),
]

# Words that don't identify a product.
STOP_WORDS = "de da do das dos e em para com por c unidade un und vl total valor codigo cod item produto mercadoria supermercado mercado ltda sa rua avenida".split()

# Words and the word they count as.
SYNONYMS = {
    "refr": "refrigerante", "refri": "refrigerante", "refrig": "refrigerante", "cerv": "cerveja", "adocante": "adoçante",
    "quilo": "kg", "quilograma": "kg", "grama": "g", "litro": "l", "mililitro": "ml", "unid": "un", "unidades": "un", "pc": "un", "pcs": "un",
}

# Names that make two products with one code differ.
VARIANTS = ["zero", "integral", "light", "diet", "tradicional", "suave", "sem acucar", "sem alcool"]

# Words of a market's type.
MARKET_TYPES = r"\b(supermercado|supermarket|mercado|atacarejo|atakarejo|hortifruti|mini|minimercado)\b"

# Category by the first pattern that a normalized name has. Read without regard to case.
CATEGORY_PATTERNS = [
    ("bebida|refrig|vinho|refresc|coca|antarct|maguary", "Bebidas"),
    ("papel|absorvent|higien", "Higiene"),
    ("amac|omo|limpe", "Limpeza"),
    ("bolo|pipoca|farinha|biscoito|acucar|empanar|mist", "Mercearia"),
    ("ovos|leite|queijo|margarina", "Laticínios"),
    ("presunto|queijo prato|frios", "Frios"),
    ("pao|padaria", "Padaria"),
    ("maca|banana|fruta|horti", "Hortifruti"),
]

# Sectors, health classes, and what older values became.
SECTORS = [
    "Laticínios", "Padaria e Confeitaria", "Carnes e Aves", "Peixes e Frutos do Mar", "Hortifruti", "Mercearia", "Bebidas", "Biscoitos e Snacks",
    "Chocolates e Doces", "Congelados", "Alimentos Naturais", "Conservas e Molhos", "Café, Chá e Achocolatados", "Temperos, Condimentos e Ingredientes",
    "Limpeza", "Higiene Pessoal", "Bebês e Crianças", "Pet", "Farmácia e Cuidados", "Casa e Utilidades", "Descartáveis", "Papelaria e Papel", "Lavanderia", "Outros",
]
HEALTH_CLASSES = ["Saudável", "Não saudável", "Não classificado"]
LEGACY_SECTORS = {"Biscoitos": "Biscoitos e Snacks", "Higiene": "Higiene Pessoal", "Padaria": "Padaria e Confeitaria", "Carnes": "Carnes e Aves", "Frios": "Carnes e Aves"}
LEGACY_HEALTH = {"Moderado": "Não saudável", "Evitar": "Não saudável"}

# Amounts with cents in receipt text; a pack's number and unit.
MONEY = r"-?(?:\d{1,3}(?:[.\s]\d{3})*[.,]\d{2}|\d+[.,]\d{2})"
PACK = r"(?:c\s*)?(\d+(?:[.,]\d+)?)\s*(kg|g|l|ml|un|und|unid|rolos|latas|garrafas|pacotes|caixas)\b"

# Hosts of fiscal pages, private hosts, names of markets in pages and names that aren't.
FISCAL_HOSTS = r"(^|\.)(fazenda\.rj\.gov\.br|sefaz\.br|sefaz\.gov\.br|gov\.br|sefazvirtual\.rs\.gov\.br|svrs\.rs\.gov\.br)$"
PRIVATE_HOSTS = r"^(localhost$|127\.|::1$|10\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
MARKET_WORDS = "supermercad|supermarket|mercado|atakarejo|atacarejo|hortifruti|sacol[aã]o|minimercado|mini mercado"
NOT_MARKETS = r"mercados\s*&\s*padarias|mercados em saquarema|lista de mercados|saquaremaonline"

#: Fixed names of the fiscal JSON formats: where a body's content stands, and the names of its fields, in order.
JSON_ROOTS = ("data", "result", "invoice", "document")
JSON_FIELDS = {
    "market": ("name", "issuerName", "razaoSocial", "nome", "emitente", "xNome"),
    "cnpj": ("cnpj", "issuerCnpj", "emitenteCnpj"),
    "date": ("date", "issueDate", "dataEmissao", "dhEmi"),
    "time": ("time", "hora"),
    "total": ("total", "grandTotal", "valorTotal", "vNF", "invoiceTotal", "amount"),
    "items": ("items", "products", "itens", "det"),
}
JSON_ITEM = {
    "code": ("barcode", "ean", "cEAN", "codigo", "cProd"),
    "name": ("name", "description", "xProd", "produto"),
    "quantity": ("quantity", "qty", "qCom", "qtd"),
    "unit": ("unit", "uCom", "unidade"),
    "unit_price": ("unitPrice", "vUnCom", "precoUnitario"),
    "total": ("total", "vProd", "valor", "lineTotal"),
    "discount": ("discount", "vDesc", "desconto"),
}

# How short words of receipts are shown, in order; number and unit in a name.
DISPLAY_RULES = [(r"\s+", " "), (r"(?i)^\s*refr\.?\s+", "Refrigerante "), (r"(?i)^\s*refri\.?\s+", "Refrigerante "), (r"(?i)^\s*cerv\.?\s+", "Cerveja "), (r"(?i)\bp\s*/\s*", "para "), (r"(?i)\bc\s*/\s*(\d+)", "c/$1"), (r"(?i)\bado[cç]ante\b", "Adoçante")]
NAME_PACK = r"(\d+(?:[.,]\d+)?)\s*(kg|g|l|ml|un)\b"

# merchants' lines, and what their kind is called; formats of item lines, quantities, units and unit prices in receipt text.
MERCHANT_REJECT = r"(?i)^(cnpj|cpf|documento|cupom|nota|fiscal|consumidor|endereco|avenida|av\.|rua|r\.|fone|tel|telefone|saquarema|data|hora|codigo|descricao|qtde|qtd|forma|pagamento|venda|valor|total|desconto)"
MERCHANT_WORDS = r"(?i)supermercad|mercado|hipermercad|atacad|alvorada|drogaria|farm[aá]cia|farmacia|padaria|hortifruti|emporio|loja"
MERCHANT_BEGINS = r"(?i)^(supermercad|mercad|drogaria|farm[aá]cia|farmacia|padaria|hiper|atacad)"
COMPANY_WORDS = r"(?i)eireli|ltda|sa\b|s\.a\.|mei\b"
TOTAL_LABELS = (r"valor\s*a\s*pagar", r"valor\s*pago", r"total\s*a\s*pagar", "^total")
DISCOUNT_LABELS = ("desconto",)
#: Any line with such a label, a payment or a count has one of these words, in capitals or not.
TOTAL_WORDS, PAYMENT_WORDS, COUNT_WORDS = ("valor", "total"), ("cart", "dito", "pix", "dinheiro", "vale"), ("itens",)
PAYMENT_LABELS = r"(?i)cart[aã]o\s+(?:de\s+)?d[eé]bito|cr[eé]dito|pix|dinheiro|vale"
ITEM_NAME_CODE = r"(?i)^(.+?)\s*\(\s*c[oó]digo\s*:\s*([0-9]{4,14})\s*\).*$"
ITEM_CODE_NAME = r"^\s*(\d{4,14})\s+(.{3,})$"
ITEM_UNITS = "UN|UND|UNID|KG|L|ML|G"
ITEM_QUANTITY = r"(?:qtde|qtd|quantidade)\s*(?:[:.]\s*)+"
ITEM_UNIT_PRICE = r"(?i)v(?:l|alor)\.?\s*unit\.?[^:]*:\s*(.*)$"
ITEM_COUNT = r"(?i)(?:qtde|qtd|quantidade)\.?\s*total\s*de\s*itens[^0-9]*(\d{1,3})"
