"""Scripts inside the stages of a script, as Column rules: what wrappers run, here-bodies, piped scripts and options that hold commands.

The rules read stages as `shell.lex` gives them. Arguments are walked from left to right by folds over their array. Quoting inside
arguments is lost, as their outer quotes are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewall.functions import let
from tidewall.functions.shell import CODE_SINKS, SHELLS

#: Fixed values
RUNNERS = [
    "sudo", "doas", "timeout", "nohup", "env", "nice", "ionice", "setsid", "stdbuf", "unbuffer", "xargs", "time", "command", "builtin",
    "exec", "unshare", "systemd-run", "chpst", "busybox", "toybox", "firejail", "bwrap", "strace", "ltrace", "valgrind", "catchsegv",
    "flock", "gosu", "fakeroot", "torify", "proxychains", "proxychains4", "nsenter", "chroot", "pkexec", "su-exec", "setpriv", "prlimit",
    "sg", "schroot",
]
CONTAINERS = ["docker", "podman", "runc", "crun", "buildah", "nerdctl", "ctr", "lxc-attach", "apptainer", "singularity", "kubectl", "flatpak"]
#: Arguments of their own that runners take before the command
OWN_ARGUMENTS = {"timeout": 1, "gosu": 1, "chroot": 1, "su-exec": 1, "sg": 1}
VALUE_FLAGS = {
    "sudo": "-u -g -p -C -T -h -U -r -t", "doas": "-u -C", "timeout": "-s --signal -k --kill-after", "nice": "-n", "ionice": "-c -n -t",
    "env": "-u --unset -C --chdir", "xargs": "-I -L -n -P -d -E -s -a --arg-file -r --replace --max-args --max-procs --max-chars",
    "stdbuf": "-i -o -e", "watch": "-n --interval -p --precise", "parallel": "-j --jobs -n --max-args -N --colsep -C --delimiter -d",
    "exec": "-a", "time": "-o --output -f --format", "unshare": "-S -G --setgroups -C --propagation", "systemd-run": "-u -p -E",
    "chpst": "-u -U -e -n -o -m -l -L -/", "strace": "-o -e -p -s -u -E -P -b", "ltrace": "-o -e -p -u -l -s",
    "flock": "-E -w --timeout", "nsenter": "-t -S -G -r -w", "pkexec": "--user", "schroot": "-c -p -u -d --session-name",
}
SSH_COMMAND_OPTIONS = ["proxycommand", "localcommand", "knownhostscommand"]
SSH_CONFIGS = ["/.ssh/config", "/etc/ssh/ssh_config", "/etc/ssh/ssh_config.d/"]
SSH_VALUE_FLAGS = "BbcDEeFIiJLlmOopQRSWw"
EXEC_FLAGS, EXEC_ENDS = ["-exec", "-execdir", "-ok", "-okdir"], [";", "\\;", "+"]

#: Why a pipeline is denied that reads a configuration which may run anything
FOREIGN_CONFIG = "a configuration of ssh from elsewhere"

_WORDS = "array<string>"


def unquoted(x: Column) -> Column:
    """x without one pair of quotes around it."""
    return F.regexp_replace(x, r"""(?s)\A(["'])(.*)\1\z""", "$2")


def _after_equals(x: Column) -> Column:
    return F.regexp_replace(x, r"\A[^=]*=", "")


def _last_part(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def _short(a: Column, letter: str) -> Column:
    return a.rlike(rf"(?s)\A-(?!-).*{letter}")


def _next(args: Column, at: Column) -> Column:
    """The argument after the one at position `at` (from 0), or nothing."""
    return F.coalesce(F.get(args, at + 1), F.lit(""))


def _joined(args: Column) -> Column:
    return F.nullif(F.array_join(args, " "), F.lit(""))


def _first_at(args: Column, test) -> Column:
    """Position from 1 of the first argument that passes, or 0."""
    return F.array_position(F.transform(args, test), F.lit(True)).cast("int")


def _words(*xs: str) -> Column:
    return F.array(*map(F.lit, xs)).cast(_WORDS)


def code_after_c(args: Column, long: bool = True) -> Column:
    """The script that -c takes, alone, in a bundle or with =."""
    glued = r"\A(?:-c|--command)=" if long else r"\A-c="
    at = _first_at(args, lambda a: a.rlike(glued) | _short(a, "c") | ((a == "--command") if long else F.lit(False)))
    return let(at, lambda at: F.when(at > 0, F.when(F.get(args, at - 1).rlike(glued), _after_equals(F.get(args, at - 1))).otherwise(F.get(args, at))))


def _found(args: Column) -> Column:
    """All clauses of find that run something, joined."""
    state = F.struct(F.lit(False).alias("open"), _words().alias("now"), _words().alias("out"))

    def step(acc: Column, a: Column) -> Column:
        ends, starts = acc["open"] & a.isin(EXEC_ENDS), ~acc["open"] & a.isin(EXEC_FLAGS)
        out = F.when(ends, F.array_append(acc["out"], F.array_join(acc["now"], " "))).otherwise(acc["out"])
        now = F.when(starts, _words()).when(acc["open"] & ~ends, F.array_append(acc["now"], a)).otherwise(acc["now"])
        return F.struct(F.when(starts, True).when(ends, False).otherwise(acc["open"]).alias("open"), now.alias("now"), out.alias("out"))

    def end(acc: Column) -> Column:
        return F.nullif(F.array_join(F.when(acc["open"], F.array_append(acc["out"], F.array_join(acc["now"], " "))).otherwise(acc["out"]), "; "), F.lit(""))

    return F.aggregate(args, state, step, end)


def _env_split(args: Column) -> Column:
    at = _first_at(args, lambda a: a.startswith("--split") | _short(a, "S"))

    def value(at: Column) -> Column:
        a, following = F.get(args, at - 1), F.get(args, at)
        attached = F.nullif(F.regexp_replace(a, r"(?s)\A[^S]*S", ""), F.lit(""))
        long = F.when(F.contains(a, F.lit("=")), _after_equals(a)).otherwise(following)
        return F.when(at > 0, F.when(a.startswith("--split"), long).otherwise(F.coalesce(attached, following)))

    return let(at, value)


def _ssh(args: Column) -> Column:
    """Struct text, refused: a command in an option, a configuration from elsewhere, or the remote command."""
    option = rf"(?is)\A(?:{'|'.join(SSH_COMMAND_OPTIONS)})(?:=| +|$)(.*)"

    def value(a: Column, at: Column, flag: str) -> Column:
        return F.when(a == flag, _next(args, at)).when(a.startswith(flag), F.substring(a, F.lit(3), F.length(a))).otherwise("")

    def one(a: Column, at: Column) -> Column:
        inner = let(value(a, at, "-o"), lambda v: F.when(v.rlike(option), unquoted(F.coalesce(F.nullif(F.regexp_extract(v, option, 1), F.lit("")), _next(args, at)))))
        config = F.regexp_replace(F.trim(value(a, at, "-F")), r"""\A["']+|["']+\z""", "")
        own = (config == "~/.ssh/config") | F.exists(F.array(*map(F.lit, SSH_CONFIGS)), lambda c: F.endswith(config, c))
        refused = (value(a, at, "-F") != "") & ~own
        inner = F.nullif(inner, F.lit(""))
        return F.struct(inner.alias("text"), F.when(inner.isNull() & refused, FOREIGN_CONFIG).alias("refused"))

    state = F.struct(F.lit(False).alias("skip"), F.lit(False).alias("host"), _words().alias("rest"))

    def step(acc: Column, a: Column) -> Column:
        flag, here = a.startswith("-"), ~acc["host"] & ~acc["skip"]
        skip = here & flag & (F.length(a) == 2) & F.contains(F.lit(SSH_VALUE_FLAGS), F.substring(a, 2, 1))
        return F.struct(skip.alias("skip"), (acc["host"] | (here & ~flag)).alias("host"), F.when(acc["host"], F.array_append(acc["rest"], a)).otherwise(acc["rest"]).alias("rest"))

    remote = F.aggregate(args, state, step, lambda acc: _joined(acc["rest"]))
    special = F.get(F.filter(F.transform(args, one), lambda x: x["text"].isNotNull() | x["refused"].isNotNull()), F.lit(0))
    return F.coalesce(special, F.struct(remote.alias("text"), F.lit(None).cast("string").alias("refused")))


def _after_runner(name: Column, args: Column) -> Column:
    """What follows a runner's own flags, their values, its own arguments and assignments."""
    takes = F.create_map(*[x for n, flags in VALUE_FLAGS.items() for x in (F.lit(n), _words(*flags.split(" ")))])
    own = F.create_map(*[x for n, k in OWN_ARGUMENTS.items() for x in (F.lit(n), F.lit(k))])
    mine, budget = F.coalesce(F.try_element_at(takes, name), _words()), F.coalesce(F.try_element_at(own, name), F.lit(0))
    state = F.struct(F.lit(False).alias("skip"), F.lit(0).alias("used"), F.lit(False).alias("on"), _words().alias("rest"))

    def step(acc: Column, a: Column) -> Column:
        here = ~acc["on"] & ~acc["skip"]
        assigns = (name == "env") & F.contains(a, F.lit("=")) & ~a.startswith("-")
        flag = ~assigns & a.startswith("-")
        argument = here & ~assigns & ~flag & (acc["used"] < budget)
        on = acc["on"] | (here & ~assigns & ~flag & ~argument)
        skip = here & flag & F.array_contains(mine, a)
        return F.struct(skip.alias("skip"), (acc["used"] + argument.cast("int")).alias("used"), on.alias("on"), F.when(on, F.array_append(acc["rest"], a)).otherwise(acc["rest"]).alias("rest"))

    def end(acc: Column) -> Column:
        rest = acc["rest"]
        cut = _first_at(rest, lambda a: a.isin(":::", "::::"))
        listed = let(cut, lambda cut: F.when(cut > 0, F.slice(rest, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(rest))
        return F.when(name == "watch", F.get(rest, F.lit(0))).when(name == "parallel", _joined(listed)).otherwise(_joined(rest))

    return F.aggregate(args, state, step, end)


def _in_container(args: Column) -> Column:
    """The -c of a shell that stands in the arguments, or of one that is made the entry."""
    state = F.struct(F.lit(False).alias("value"), F.lit(False).alias("entry"), F.lit(0).alias("at"), F.lit(0).alias("seen"))

    def step(acc: Column, a: Column) -> Column:
        on = acc["at"] == 0
        flag = on & ~acc["value"] & F.substring_index(a, "=", 1).isin("--entrypoint", "--command")
        glued = flag & F.contains(a, F.lit("="))
        shell = _last_part(a).isin(SHELLS)
        entry = acc["entry"] | (on & acc["value"] & shell) | (glued & _last_part(_after_equals(a)).isin(SHELLS))
        at = F.when(on & ~acc["value"] & ~flag & shell, acc["seen"] + 1).otherwise(acc["at"])
        return F.struct((flag & ~glued).alias("value"), entry.alias("entry"), at.alias("at"), (acc["seen"] + 1).alias("seen"))

    def end(acc: Column) -> Column:
        rest = F.slice(args, acc["at"] + 1, F.greatest(F.size(args) - acc["at"], F.lit(0)))
        return F.when(acc["at"] > 0, code_after_c(rest)).when(acc["entry"], code_after_c(args, long=False))

    return F.aggregate(args, state, step, end)


def wrapped(stage: Column) -> Column:
    """Struct text, refused: the command that a wrapper runs (null or blank: none), or why it is not looked for."""
    name, args = stage["name"], stage["args"]
    plain = (
        F.when(name.isin([*SHELLS, "su", "runuser"]), code_after_c(args))
        .when(name == "eval", _joined(args))
        .when(name == "find", _found(args))
        .when(name == "env", F.coalesce(_env_split(args), _after_runner(name, args)))
        .when(name == "flock", F.coalesce(code_after_c(args), _after_runner(name, args)))
        .when(name.isin([*RUNNERS, "watch", "parallel"]), _after_runner(name, args))
        .when(name.isin(CONTAINERS), _in_container(args))
    )
    return F.when(name == "ssh", _ssh(args)).otherwise(F.struct(plain.alias("text"), F.lit(None).cast("string").alias("refused")))


def _stdin_text(stages: Column) -> Column:
    """What the stages before a shell may print to it."""

    def one(s: Column) -> Column:
        said = F.array_join(F.concat(F.array(s["argv0"]), F.transform(s["args"], unquoted)), " ")
        bodies = F.transform(s["redirects"], lambda r: F.coalesce(r["body"], F.when(r["kind"] == "herestring", unquoted(r["target"]))))
        return F.concat(F.array(said), F.filter(bodies, lambda b: b.isNotNull()))

    return F.array_join(F.flatten(F.transform(stages, one)), "\n")


def inner_texts(stages: Column) -> Column:
    """Array of struct policy, origin, text: texts in a pipeline's stages that run as scripts, in the order in which they are judged."""
    none = F.array().cast("array<struct<policy:int,origin:string,text:string>>")

    def item(policy: int, origin: str, text: Column) -> Column:
        return F.struct(F.lit(policy).alias("policy"), F.lit(origin).alias("origin"), text.alias("text"))

    def some(values: Column) -> Column:
        return F.filter(values, lambda x: x["text"].isNotNull())

    def of(s: Column, k: Column) -> Column:
        args = s["args"]
        bodies = F.transform(
            F.filter(s["redirects"], lambda r: r["kind"].isin("heredoc", "herestring")),
            lambda r: item(8, "here_body", F.when(r["kind"] == "heredoc", r["body"]).otherwise(unquoted(r["target"]))),
        )
        piped = (k > 0) & F.exists(args, lambda a: _short(a, "s") & ~_short(a, "c"))
        stdin = F.when(piped, F.array(item(9, "stdin", _stdin_text(F.slice(stages, F.lit(1), k))))).otherwise(none)

        def remote_shell(a: Column, at: Column) -> Column:
            value = F.when(a.startswith("--rsh="), F.substring(a, F.lit(7), F.length(a))).when((a == "--rsh") | _short(a, "e"), _next(args, at))
            return item(13, "rsync_rsh", unquoted(value))

        def archive(a: Column, at: Column) -> Column:
            flag = F.substring_index(a, "=", 1)
            value = F.when(F.contains(a, F.lit("=")), _after_equals(a)).otherwise(_next(args, at))
            runs = (F.length(flag) >= 6) & F.lit("--to-command").startswith(flag)
            acts = (F.length(flag) >= 14) & F.lit("--checkpoint-action").startswith(flag) & value.startswith("exec=")
            return item(14, "tar_exec", unquoted(F.when(runs, value).when(acts, F.substring(value, F.lit(6), F.length(value)))))

        return F.concat(
            F.when(s["name"].isin(CODE_SINKS), F.concat(bodies, stdin)).otherwise(none),
            F.when(s["basename"] == "rsync", some(F.transform(args, remote_shell))).otherwise(none),
            F.when(s["name"] == "tar", some(F.transform(args, archive))).otherwise(none),
        )

    return F.flatten(F.transform(stages, of))
