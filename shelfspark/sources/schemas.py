"""Schemas of the library tables. Names and widths are fixed values of the domain's format."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType()}

_DDL = {
    "LIVROS": "LVRCODIGO long, LVRTITULO string, LVRISBN string, LVREDICAO int, LVRDTPUBLIC date, LVRSINOPSE string, LVRFAIXAETARIA int",
    "AUTORES": "AUTCODIGO long, AUTNOME string, AUTPSEUDONIMO string, AUTBIOGRAFIA string, AUTPAISNASC string",
    "GENEROS": "GNRCODIGO long, GNRNOME string",
    "AUTORIA": "ATRLIVRO long, ATRAUTOR long, ATRPRINCIPAL boolean",
    "CLASSIFICACAO": "CLSLIVRO long, CLSGENERO long, CLSPRINCIPAL boolean",
    "EXEMPLARES": "EXMCODIGO long, EXMLIVRO long, EXMDTAQUISICAO date, EXMDISPONIVEL boolean",
    "CLIENTES": "CLICODIGO long, CLINOME string, CLICPF string, CLITELEFONE string, CLIEMAIL string, CLIDTNASC date, CLIDTCAD date",
    "NIVEIS": "NVLCODIGO long, NVLNOME string",
    "USUARIOS": "USRCODIGO long, USRNOME string, USRCPF string, USRLOGIN string, USRSENHA string, USRNIVEL long, USREMAIL string, USRDTCAD date",
    "EMPRESTIMOS": "EMPCODIGO long, EMPLIVRO long, EMPUSUARIO long, EMPCLIENTE long, EMPDTEMPR date, EMPDTDEVOL date",
    "AUDITORIAS": "AUDCODIGO long, AUDUSUARIO long, AUDACAO string, AUDTABELA string, AUDREGISTRO long, AUDANTES string, AUDDEPOIS string, AUDDATA timestamp",
    "users": "id long, name string, email string, email_verified_at timestamp, password string, remember_token string, created_at timestamp, updated_at timestamp",
}

SCHEMAS: dict[str, StructType] = {name: StructType([StructField(c, _TYPES[t]) for c, t in (x.split() for x in ddl.split(", "))]) for name, ddl in _DDL.items()}

#: Columns that never leave the system, by table.
HIDDEN = {"users": ["password", "remember_token"], "USUARIOS": ["USRSENHA"]}

PRIMARY_KEYS = {
    "LIVROS": ["LVRCODIGO"], "AUTORES": ["AUTCODIGO"], "GENEROS": ["GNRCODIGO"], "AUTORIA": ["ATRLIVRO", "ATRAUTOR"], "CLASSIFICACAO": ["CLSLIVRO", "CLSGENERO"],
    "EXEMPLARES": ["EXMCODIGO"], "CLIENTES": ["CLICODIGO"], "NIVEIS": ["NVLCODIGO"], "USUARIOS": ["USRCODIGO"], "EMPRESTIMOS": ["EMPCODIGO"], "AUDITORIAS": ["AUDCODIGO"], "users": ["id"],
}

UNIQUE_KEYS = {"LIVROS": ["LVRISBN"], "CLIENTES": ["CLICPF"], "USUARIOS": ["USRCPF", "USRLOGIN", "USREMAIL"], "GENEROS": ["GNRNOME"], "NIVEIS": ["NVLNOME"], "users": ["email"]}

#: (child, column, parent, column, what a parent's deletion does)
FOREIGN_KEYS = [
    ("CLASSIFICACAO", "CLSLIVRO", "LIVROS", "LVRCODIGO", "cascade"),
    ("CLASSIFICACAO", "CLSGENERO", "GENEROS", "GNRCODIGO", "cascade"),
    ("AUTORIA", "ATRLIVRO", "LIVROS", "LVRCODIGO", "cascade"),
    ("AUTORIA", "ATRAUTOR", "AUTORES", "AUTCODIGO", "cascade"),
    ("EMPRESTIMOS", "EMPLIVRO", "LIVROS", "LVRCODIGO", "restrict"),
    ("EMPRESTIMOS", "EMPUSUARIO", "USUARIOS", "USRCODIGO", "restrict"),
    ("EMPRESTIMOS", "EMPCLIENTE", "CLIENTES", "CLICODIGO", "restrict"),
    ("EXEMPLARES", "EXMLIVRO", "LIVROS", "LVRCODIGO", "restrict"),
    ("USUARIOS", "USRNIVEL", "NIVEIS", "NVLCODIGO", "restrict"),
]
