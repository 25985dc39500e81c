from clausewright import runtime
from clausewright.__main__ import main


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("1. INDEMNITY\n\nThe Supplier shall indemnify the Client.")
    assert main([str(tmp_path)]) == 0
    assert "Indemnity" in capsys.readouterr().out
    (tmp_path / "bad.bin").write_text("?")
    assert main([str(tmp_path), "--json"]) == 1
    assert main([]) == 2 and main(["--nonsense"]) == 2 and main(["--check"]) == 0


def test_runtime(tmp_path):
    assert runtime.processor("AMD64") == "x64" and runtime.processor("aarch64") == "arm64" and runtime.processor("riscv") == "riscv"
    assert runtime.model_file(tmp_path) is None
    (tmp_path / "model.onnx").touch()
    assert runtime.model_file(tmp_path) is None
    (tmp_path / "vocab.txt").touch()
    (tmp_path / "model_int8.onnx").touch()
    assert runtime.model_file(tmp_path).name == "model_int8.onnx"
