"""Column functions: text, chat, completions, frames."""
