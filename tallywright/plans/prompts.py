"""Default prompt and model catalogues; jobs may pass their own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.labels import LABELS

# The models compared.
MODELS = ["gemini-2.5-flash-lite", "gpt-5-nano", "llama-3.1-8b-instant"]

_CHOICES = ", ".join(LABELS)

# The prompt ids are fixed values; the wording is a default that a catalogue file can replace.
PROMPTS = [
    {
        "id": "zero_shot_direto",
        "template": f'Classifique a mensagem em uma destas categorias: {_CHOICES}.\n\n"{{demanda}}"\n\nCategoria:',
    },
    {
        "id": "zero_shot_cot",
        "template": (
            f"Categorias: {_CHOICES}.\nPense em voz alta e termine com a linha "
            '"Categoria Final: <categoria>".\n\n"{demanda}"\n\nRaciocínio:'
        ),
    },
    {
        "id": "few_shot_completo",
        "template": (
            "Exemplos:\n"
            '"Parabéns pelo atendimento." -> Elogio\n'
            '"O prazo não foi cumprido." -> Crítica\n'
            '"Seria bom ter um aplicativo." -> Sugestão\n'
            '"Peço cópia do contrato." -> Pedido de LAI\n'
            '"Preciso de uma segunda via." -> Solicitação\n'
            '"Há desvio de verba na obra." -> Denúncia\n\n"{demanda}" ->'
        ),
    },
    {
        "id": "meta_prompt_classificacao",
        "template": (
            f"Escreva o melhor prompt para separar mensagens em {_CHOICES}; aplique-o à mensagem abaixo e "
            'responda só com a categoria.\n\n"{demanda}"'
        ),
    },
]


def load_prompts(spark: SparkSession, path: str) -> list[dict]:
    """A prompt catalogue (fields ``id`` and ``template``) from a JSON-lines file."""
    rows = spark.read.schema("id string, template string").json(path).collect()
    return [row.asDict() for row in rows]
