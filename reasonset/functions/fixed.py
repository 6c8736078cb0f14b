"""Texts and patterns that must be exactly these for the results to be right."""

# Reasoning marks.
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
TAG_STYLES = [
    ("<think>", "</think>"),
    ("<|thinking|>", "<|/thinking|>"),
    ("<thinking>", "</thinking>"),
]

# Roles.
USER_ROLES = ["human", "user"]
ASSISTANT_ROLES = ["gpt", "assistant"]

# Answer patterns. The first is the usual \boxed{...} with one level of inner braces; its
# quantifiers are possessive, which matches the same texts without deep backtracking.
BOXED_NESTED = r"\\boxed\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
BOXED_SIMPLE = r"\\boxed\{([^}]+)\}"
BOXED_LETTER = r"\\boxed\{([A-D])\}"
ANSWER_LINE = r"(?i)ANSWER:\s*([^\n]+)"
SIGNED_INTEGER = r"[-+]?\d+"
CODE_FENCE = r"(?s)```(?:[a-zA-Z]*)\n(.*?)```"
FINAL_ANSWER_MARK = "####"

# Run names and paths.
RUN_CONFIG = (
    r"^(.+?)_s(\d+\.?\d*)_bs(\d+)_lr([^_]+)_e(\d+)(?:_r(\d+))?"
    r"(?:_c(none|easy_to_hard|first_epoch_only|grouped_shuffle))?_(.+)$"
)
MODEL_SUFFIX = r"_([^_]+_[^_]+)$"

# Lines of a comparison summary.
SUMMARY_PASSED = r"Passed: (\d+)/(\d+) \((\d+\.\d+)%\)"
SUMMARY_FLIPS = r"Total outcome differences found: (\d+)"
SUMMARY_SAME_DIFF = r"Same outcome, different response: (\d+) total"

# Prompt texts.
MATH_PROMPT = """Problem: {problem}
Mark your solution with \\boxed
Answer:"""
CHOICE_OPTION = "{letter}) {option}"
CHOICE_PROMPT = """Problem: {question}

Options:
{options}

Return your final response within \\boxed{} and only include the letter choice (A, B, C, or D) as your final response."""
CODE_STDIN_PROMPT = """Generate an executable Python function generated from the given prompt. The function should take stdin as input and print the output. Simply call the function after the definition.
{problem}"""
CODE_FUNCTION_PROMPT = """Generate an executable Python function generated from the given prompt. Return the function body without invoking it at the final solution.
{problem}"""
WORD_PROMPT = "{question} Provide a numerical answer without units, written inside \\boxed{}."
WORD_EXAMPLE_USER = "How many r's are in strawberry?"
WORD_EXAMPLE_ASSISTANT = "Let's spell the word out and number all the letters: 1) s 2) t 3) r 4) a 5) w 6) b 7) e 8) r 9) r 10) y. We have r's at positions 3, 8, and 9. \\boxed{3}"

# Documents.
SAMPLE_DOCUMENT = """# Sample {sample}

**Source:** {source}  
**Domain:** {domain}  
**Difficulty:** {difficulty}

---

## User Input

{user_text}

---

## Thinking Tokens

{reasoning}

---

## Output

{output}
"""
COMPARISON_RUN = """
{run}:
  Passed: {passed}/{total} ({percent}%)
  Failed: {failed}/{total}
"""
COMPARISON_SUMMARY = """Results Comparison - {title}

Summary by Timestamp:
{runs}
Total outcome differences found: {flips}
Same outcome, different response: {same} total
  - Both passed, different response: {same_passed}
  - Both failed, different response: {same_failed}
"""
DIFFERENCE_DOCUMENT = """Question Index: {problem}
Timestamp: {run}
Status: {status}
Extracted Answer: {answer}
Correct Answer: {correct}

RESPONSE:
{response}
"""
PROMPT_DOCUMENT = """Question Index: {problem}

PROMPT:
{prompt}
"""
FLIP_LINE = "{run}: {status} (answered: {answer}, correct: {correct})"

# Messages shown in place of missing things.
NO_CONVERSATION = "No conversation"
NO_USER_MESSAGE = "No user message found"
NO_REASONING = "*No thinking tokens found*"
NO_CODE = "No code found"
NOT_AVAILABLE = "N/A"
