"""What the code checks report, as one table."""

from __future__ import annotations

from dataclasses import dataclass

from quarry.config import (
    HIGH_COGNITIVE,
    HIGH_CYCLOMATIC,
    LONG_METHOD_LINES,
    LONG_PARAMETERS,
)


@dataclass(frozen=True)
class Wording:
    """Texts hold ``{name}`` places that a check fills from its row."""

    severity: str
    category: str
    confidence: float
    title: str
    description: str
    recommendation: str


# Severities, categories, confidences and texts of the findings.
WORDING = {
    "python_syntax": Wording(
        "High", "Maintainability", 1.0,
        "Code does not parse",
        "Python syntax error: {message} (line {line}).",
        "Fix the syntax error before further analysis can run.",
    ),
    "python_long_function": Wording(
        "Medium", "Long Method", 0.95,
        "Long method: {name}",
        f"'{{name}}' spans {{span}} lines, above the {LONG_METHOD_LINES}-line guideline.",
        "Break this into smaller, single-purpose helper functions.",
    ),
    "python_cyclomatic": Wording(
        "High", "Complexity", 0.9,
        "High cyclomatic complexity: {name}",
        f"'{{name}}' has an estimated cyclomatic complexity of {{cyclomatic}}, above {HIGH_CYCLOMATIC}.",
        "Reduce nested conditionals/loops; extract branches into separate functions.",
    ),
    "python_cognitive": Wording(
        "Medium", "Cognitive Complexity", 0.82,
        "High cognitive complexity: {name}",
        f"'{{name}}' has an estimated cognitive complexity of {{cognitive}}, above {HIGH_COGNITIVE} — likely hard"
        " for a human to follow even if cyclomatic complexity looks moderate.",
        "Reduce nesting depth — prefer early returns/guard clauses over deeply nested conditionals.",
    ),
    "python_parameters": Wording(
        "Low", "Design Anti-pattern", 0.9,
        "Long parameter list: {name}",
        f"'{{name}}' takes {{parameters}} parameters, above the {LONG_PARAMETERS}-parameter guideline.",
        "Group related parameters into a dataclass/object, or split the function.",
    ),
    "python_magic_number": Wording(
        "Low", "Maintainability", 0.7,
        "Magic number in {name}: {value}",
        "The literal {value} is used directly in a condition/call inside '{name}' without a named constant.",
        "Replace {value} with a named constant that explains what it represents.",
    ),
    "python_unused_variable": Wording(
        "Low", "Unused Variable", 0.7,
        "Possibly unused variable: {variable}",
        "'{variable}' is assigned inside '{name}' but never read afterward (best-effort — doesn't model all"
        " control flow).",
        "Remove the variable if unused, or use it / prefix with '_' to signal intent.",
    ),
    "python_function_name": Wording(
        "Low", "Naming Convention", 0.95,
        "Naming convention: {name}",
        "Function '{name}' doesn't follow snake_case (PEP 8).",
        "Rename to '{suggestion}'.",
    ),
    "python_class_name": Wording(
        "Low", "Naming Convention", 0.95,
        "Naming convention: {name}",
        "Class '{name}' doesn't follow PascalCase (PEP 8).",
        "Rename the class using PascalCase.",
    ),
    "python_unused_import": Wording(
        "Low", "Unused Import", 0.88,
        "Unused import: {name}",
        "'{name}' is imported but never referenced in the file.",
        "Remove the unused import '{name}'.",
    ),
    "python_god_class": Wording(
        "Medium", "SOLID: Single Responsibility Principle", 0.7,
        "Possible God Object: {name}",
        "Class '{name}' has {methods} methods and spans {span} lines — it may be taking on too many responsibilities.",
        "Split this class into smaller classes, each with a single, clearly-named responsibility.",
    ),
    "python_fat_interface": Wording(
        "Low", "SOLID: Interface Segregation Principle", 0.6,
        "Possible fat interface: {name}",
        "Abstract class '{name}' declares {abstract_methods} abstract methods — implementers may be forced to"
        " depend on methods they don't use.",
        "Split this interface into smaller, more focused interfaces/protocols.",
    ),
    "python_concrete_classes": Wording(
        "Low", "SOLID: Dependency Inversion Principle", 0.5,
        "Possible Dependency Inversion violation: {name}",
        "Class '{name}' directly instantiates {number} concrete classes inside its methods ({concrete}).",
        "Depend on abstractions injected via the constructor instead of instantiating concrete classes directly"
        " inside methods.",
    ),
    "java_class_name": Wording(
        "Low", "Naming Convention", 0.9,
        "Naming convention: {name}",
        "Class '{name}' doesn't follow PascalCase, the standard Java convention.",
        "Rename the class using PascalCase.",
    ),
    "java_god_class": Wording(
        "Medium", "SOLID: Single Responsibility Principle", 0.65,
        "Possible God Object: {name}",
        "Class '{name}' has approximately {methods} methods, {fields} fields, and spans {span} lines — it may be"
        " taking on too many responsibilities.",
        "Split this class into smaller classes, each with a single, clearly-named responsibility.",
    ),
    "java_concrete_classes": Wording(
        "Low", "SOLID: Dependency Inversion Principle", 0.45,
        "Possible Dependency Inversion violation: {name}",
        "Class '{name}' directly instantiates {number} concrete classes with 'new' ({concrete}).",
        "Depend on interfaces injected via the constructor instead of instantiating concrete classes directly.",
    ),
    "java_fat_interface": Wording(
        "Low", "SOLID: Interface Segregation Principle", 0.6,
        "Possible fat interface: {name}",
        "Interface '{name}' declares approximately {methods} methods — implementers may be forced to depend on"
        " methods they don't use.",
        "Split this interface into smaller, more focused interfaces.",
    ),
    "java_long_method": Wording(
        "Medium", "Long Method", 0.85,
        "Long method: {name}",
        f"'{{name}}' spans approximately {{span}} lines, above {LONG_METHOD_LINES}.",
        "Break this into smaller, single-purpose helper methods.",
    ),
    "java_cyclomatic": Wording(
        "High", "Complexity", 0.8,
        "High cyclomatic complexity: {name}",
        f"'{{name}}' has an estimated cyclomatic complexity of {{cyclomatic}}, above {HIGH_CYCLOMATIC}.",
        "Reduce nested conditionals/loops; extract branches into separate methods.",
    ),
    "java_cognitive": Wording(
        "Medium", "Cognitive Complexity", 0.7,
        "High cognitive complexity: {name}",
        f"'{{name}}' has an estimated cognitive complexity of {{cognitive}}, above {HIGH_COGNITIVE}.",
        "Reduce nesting depth — prefer early returns/guard clauses.",
    ),
    "java_parameters": Wording(
        "Low", "Design Anti-pattern", 0.8,
        "Long parameter list: {name}",
        f"'{{name}}' takes approximately {{parameters}} parameters, above {LONG_PARAMETERS}.",
        "Group related parameters into a class/record, or split the method.",
    ),
    "java_method_name": Wording(
        "Low", "Naming Convention", 0.9,
        "Naming convention: {name}",
        "Method '{name}' doesn't follow camelCase, the standard Java convention.",
        "Rename the method using camelCase.",
    ),
    "java_unused_import": Wording(
        "Low", "Unused Import", 0.85,
        "Unused import: {name}",
        "'{name}' is imported but doesn't appear to be used elsewhere in the file.",
        "Remove the unused import '{name}'.",
    ),
    "equal_block": Wording(
        "Medium", "Duplicate Code", 0.9,
        "Duplicate code block",
        "Lines {here} are an exact duplicate of lines {there}.",
        "Extract the repeated block into a shared function/method.",
    ),
    "alike_block": Wording(
        "Low", "Duplicate Code", 0.72,
        "Structurally duplicate code block",
        "Lines {here} are structurally identical to lines {there}, possibly with renamed variables.",
        "Check whether this is intentional duplication; consider extracting a shared, parameterized function.",
    ),
}
