"""Default prompt wording. All jobs take other templates with the same holes."""

REWRITE_BODY = """Turn this ticket into one clear problem statement in its own language. Keep every
technical detail, deadline and sign of urgency, drop small talk, and return the text only.

Ticket:
{body}

Problem statement:"""

REWRITE_ANSWER = """Reduce this support answer to its solution. Keep steps, status and dates, drop
greetings and closing words, stay in its language, and return the text only.

Answer:
{answer}

Solution:"""

FAITHFULNESS = """Judge how much of the answer is backed by the context, from 0 to 1.

Context:
{context}

Answer:
{answer}

Reply as JSON: {{"score": <number>, "explanation": "<reason>"}}"""

ANSWER_RELEVANCY = """Judge how well the answer meets the question, from 0 to 1.

Question:
{query}

Answer:
{answer}

Reply as JSON: {{"score": <number>, "explanation": "<reason>"}}"""

CONTEXT_PRECISION = """Judge which share of the context helps with the question, from 0 to 1.

Question:
{query}

Context:
{context}

Reply as JSON: {{"score": <number>, "explanation": "<reason>"}}"""

CONTEXT_RECALL = """Judge which share of the expected answer the context contains, from 0 to 1.

Question:
{query}

Expected answer:
{ground_truth}

Context:
{context}

Reply as JSON: {{"score": <number>, "explanation": "<reason>"}}"""

CLASSIFY = {
    "en": """Name topic and intent of this ticket as JSON with the keys topic and intent.
Ticket:
{issue_description}""",
    "de": """Nenne Thema und Absicht dieses Tickets als JSON mit den Schlüsseln topic und intent.
Ticket:
{issue_description}""",
}

PRIORITY = {
    "en": """Answer with one of URGENT, HIGH, MEDIUM, LOW.
Ticket:
{issue_description}""",
    "de": """Antworte mit einem von URGENT, HIGH, MEDIUM, LOW.
Ticket:
{issue_description}""",
}

RESPONSE = {
    "en": """Priority {priority_level}, topic {topic}, intent {intent}.

Issue:
{issue_description}

Known articles:
{context}

Reply:""",
    "de": """Priorität {priority_level}, Thema {topic}, Absicht {intent}.

Anliegen:
{issue_description}

Bekannte Artikel:
{context}

Antwort:""",
}

ANSWER_TYPE = """Answer with one of RESOLUTION, CLARIFICATION, ESCALATION, PARTIAL.

Ticket:
{body}

Answer:
{answer}

Type:"""
