"""Vocabularies; every job takes them as parameters with these defaults."""

from __future__ import annotations

# Names, aliases and terms that results depend on.

REGIONS = [
    "Meio Oeste",
    "Oeste",
    "Extremo Oeste",
    "Centro Norte",
    "Grande Florianópolis",
    "Serra",
    "Vale do Itajaí",
    "Foz do Itajaí",
    "Norte",
    "Sul",
]

#: Values of a region that mean the whole state; the first is the default.
STATE_WIDE = ["Santa Catarina", "SC", "Estadual"]

THEMES = {
    "empresas": ["abertura de empresas", "empresas ativas", "baixa de empresas", "cnpj", "estabelecimento", "sobrevivencia de empresas"],
    "empreendedorismo": ["empreendedor", "empreendedorismo", "mei", "microempreendedor", "perfil do empreendedor"],
    "emprego": ["caged", "emprego formal", "saldo de empregos", "admissoes", "desligamentos", "massa salarial", "rais"],
    "economia": ["pib", "inflacao", "ipca", "conjuntura", "atividade economica", "faturamento", "cenario economico"],
    "consumo": ["potencial de consumo", "habitos de consumo", "varejo", "comportamento do consumidor", "ticket medio"],
    "territorio": ["territorial", "regionalizacao", "municipios", "desenvolvimento regional"],
    "turismo": ["turismo", "turista", "hotelaria", "ocupacao hoteleira", "sazonalidade", "eventos"],
    "credito": ["credito", "financiamento", "juros", "endividamento", "capital de giro", "inadimplencia"],
    "inovacao": ["inovacao", "startup", "tecnologia", "digitalizacao", "transformacao digital", "inteligencia artificial"],
}

SECTORS = {
    "Comércio": ["comercio", "varejo", "atacado", "lojista"],
    "Serviços": ["servicos", "prestador de servico"],
    "Indústria": ["industria", "industrial", "manufatura", "fabril"],
    "Agronegócio": ["agronegocio", "agropecuaria", "rural", "agricultura"],
    "Construção Civil": ["construcao civil", "construcao"],
    "Turismo": ["turismo", "hotelaria", "gastronomia"],
}

#: Ways to name a company size, first match wins.
SIZE_ALIASES = {
    "mei": "MEI",
    "meis": "MEI",
    "microempreendedor": "MEI",
    "microempreendedores": "MEI",
    "me": "ME",
    "microempresa": "ME",
    "microempresas": "ME",
    "epp": "EPP",
    "pequeno porte": "EPP",
}

SIZE_CODES = {
    "EMPRESA DE PEQUENO PORTE": "EPP",
    "MICRO EMPRESA": "ME",
    "MICROEMPREENDEDOR INDIVIDUAL": "MEI",
}

SIZE_LABELS = {"MEI": "MEIs ativos", "ME": "Microempresas ativas", "EPP": "Empresas de pequeno porte ativas"}
DEFAULT_LABEL = "Empresas ativas"

#: Places that no question means as a municipality; add an organisation's own names.
GENERIC_PLACES = ["santa catarina", "sc", "estado", "brasil"]

QUANTITATIVE_TERMS = ["quantos", "quantidade", "total", "número", "valor", "quantas", "top"]
RANKING_TERMS = ["ranking", "top ", "maiores", "principais municipios", "principais municípios", "quais municipios", "quais municípios"]
BREAKDOWN_TERMS = ["por porte", "distribuicao", "distribuição", "composicao", "composição", "abertura por porte"]

MONTHS = {"jan": "01", "fev": "02", "mar": "03", "abr": "04", "mai": "05", "jun": "06", "jul": "07", "ago": "08", "set": "09", "out": "10", "nov": "11", "dez": "12"}

STOPWORDS = (
    "para com por dos das nos nas que uma sobre como mais seus suas pelo pela entre ser foi sao tem pode deve essa esse isso "
    "the and for are this that from with"
).split()
