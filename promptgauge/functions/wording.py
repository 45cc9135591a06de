"""Fixed wording of generation requests."""

# The texts below are part of the expected results and must stay as they are.

EXAMPLES = {
    "retrieval": {
        "valid": [
            "Query for retrieval:",
            "Retrieve relevant text:",
            "Encode for retrieval:",
            "Search query representation:",
            "Text for retrieval task:",
        ],
        "invalid": [
            "Summarize the following text:",
            "Extract key entities:",
            "Classify the topic:",
            "Is this about climate change?",
            "Find information about dogs:",
        ],
    },
    "classification": {
        "valid": [
            "Classify this text:",
            "Text classification input:",
            "Assign a label to this text:",
            "Category prediction:",
            "Label this example:",
        ],
        "invalid": [
            "Summarize the text:",
            "Retrieve relevant documents:",
            "Compare similarity between texts:",
            "Cluster these sentences:",
            "Search query:",
        ],
    },
    "semantic-similarity": {
        "valid": [
            "Compare semantic similarity:",
            "Similarity between texts:",
            "Semantic matching input:",
            "Text pair similarity:",
            "Measure similarity:",
        ],
        "invalid": [
            "Classify this text:",
            "Summarize the document:",
            "Retrieve relevant passages:",
            "Cluster these texts:",
            "Extract entities:",
        ],
    },
    "clustering": {
        "valid": [
            "Group similar texts:",
            "Cluster this text:",
            "Text clustering input:",
            "Assign to a cluster:",
            "Cluster representation:",
        ],
        "invalid": [
            "Classify this text:",
            "Retrieve relevant documents:",
            "Compare similarity score:",
            "Summarize the text:",
            "Answer the question:",
        ],
    },
}

RULE_SECTION = """
## TASK CONSISTENCY RULE (CRITICAL)

All generated prompts must express the SAME task as defined in the Context.

- The task is: "{task}"
- Prompts must ONLY correspond to this task
- Prompts must NOT introduce other NLP tasks or new semantics

### VALID PROMPTS (correct behavior)

{valid}

### INVALID PROMPTS (forbidden)

❌ Task change or semantic drift:
{invalid}

### HARD CONSTRAINT

Each prompt MUST:
- Preserve the original task ("{task}")
- Be a rephrasing, NOT a reinterpretation
- Avoid introducing new tasks, domains, or entities
- Remain consistent with the provided Context

If a prompt cannot be generated without adding new information → DO NOT generate it.
"""

LANGUAGE_SECTION = """
### LANGUAGE CONSTRAINT

- All prompts MUST explicitly specify the language: "{language}"
- The language must be clearly mentioned in each prompt (e.g., "in {language}")
"""

DATASET_SECTION = """
### DATASET GROUNDING

- Prompts should reflect the dataset context when possible
- Use only information explicitly present: "{dataset_description}"
- Do NOT introduce new domains or entities beyond this description
"""

REQUEST = """You are generating instruction prefixes for embedding models.

These prefixes will be prepended to input text before encoding. Your goal is to create controlled variations of such prefixes.

---

## STRICT RULES

1. Use ONLY information explicitly present in the Context.
2. DO NOT introduce new tasks, domains, or entities.
3. If information is missing (e.g., language or dataset), DO NOT guess or infer it.
4. Every prompt MUST be grounded in the provided task description.
5. Prompts must differ in wording, perspective, or format - NOT in meaning.
6. Each prompt must be a prefix (not a full sentence explanation).
7. No duplicates or near-duplicates.


Carefully read the Context section. Analyze, what information is available to you.
It is CRUCIAL that you will not infer anything that is not in the Context.

HARD CONSTRAINT:
If any field in the Context is empty or missing, you MUST ignore it completely.
Do NOT infer, assume, or complete missing information.
Any violation makes the output invalid.

## PROMPT TYPES
You MUST vary across these styles:

* Label-style (e.g., "Query:", "Passage:")
* Instruction-style (e.g., "Encode this query for retrieval:")
* Task-aware (explicitly referencing the task)
* Minimal semantic hints (short but meaningful)
* Reformulations (same meaning, different phrasing)

---

## COUNT CONSTRAINT

Generate EXACTLY {n} prompts.

---

{add_rules}

---

Before output:

* Count the prompts
* If not exactly {n}, fix the list

---

## OUTPUT FORMAT (STRICT JSON)

{
"prompts": [
"...",
"...",
...
]
}

No explanations. No extra text.

---

## CONTEXT

Task: {task_description}
Language: {language}
Dataset: {dataset_description}"""
